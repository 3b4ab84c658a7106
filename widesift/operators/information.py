"""Mutual information between a continuous feature and a class, by nearest neighbours.

The estimator (Ross 2014, after Kraskov et al.): for each training value take the distance r to its k-th
nearest value of the same class, count the values m of any class that are strictly closer (itself
included), and return max(0, psi(N) + mean psi(k) - mean psi(class size) - mean psi(m)).

In one dimension neighbours are adjacent in sorted order, so r needs only lag/lead, and m is the
difference of two positions in the sorted feature. Every value sends two probes, its interval ends,
into the same ordering as the values; one running count answers all of them. No pair of samples is
formed and no feature is collected: the work is n log n in sorts that Spark spreads and spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from widesift.functions.columns import digamma, unit_hash
from widesift.operators import ranking
from widesift.operators.scores import scorer
from widesift.session import broadcast_if_bounded, cut_lineage

KEYS = ["cohort", "seed", "feature"]
NEIGHBOURS = 3
JITTER = 1e-10


def _steps(window, prefix: str = "") -> dict[str, Column]:
    around = {}
    for j in range(1, NEIGHBOURS + 1):
        around[f"_prev{j}{prefix}"] = F.lag("x", j).over(window)
        around[f"_next{j}{prefix}"] = F.lead("x", j).over(window)
    return around


def _class_neighbours(points: DataFrame, bucketed: bool) -> DataFrame:
    """Adds the NEIGHBOURS values before and after each value within its feature and class.

    With buckets, a bucket sees its own rows only. Rows near a bucket edge (the first and last
    NEIGHBOURS of each bucket, a few rows per bucket) are then ordered once more on their own; among
    them the neighbours across the edge are adjacent, and fill what the bucket could not see.
    """
    of_class = [*KEYS, "label"]
    if not bucketed:
        return points.withColumns(_steps(Window.partitionBy(*of_class).orderBy("x", "sample_id")))
    spread = [*of_class, ranking.BUCKET]
    order = Window.partitionBy(*spread).orderBy("x", "sample_id")
    local = points.withColumns(_steps(order) | {
        "_place": F.row_number().over(order), "_size": F.count("*").over(Window.partitionBy(*spread))})
    interior = (F.col("_place") > NEIGHBOURS) & (F.col("_place") <= F.col("_size") - NEIGHBOURS)
    edge = local.where(~interior).withColumns(
        _steps(Window.partitionBy(*of_class).orderBy("x", "sample_id"), "e"))
    names = [f"_{side}{j}" for side in ("prev", "next") for j in range(1, NEIGHBOURS + 1)]
    edge = edge.withColumns({n: F.coalesce(n, f"{n}e") for n in names}).drop(*[f"{n}e" for n in names])
    return local.where(interior).unionByName(edge).drop("_place", "_size")


def _intervals(points: DataFrame) -> DataFrame:
    """Adds k, and the open interval (`lo`, `hi`) that holds exactly the values closer than the k-th.

    The k-th smallest of two ascending lists is the least, over i + j = k, of the greater of the i-th of
    one and the j-th of the other. The end on the side of the k-th neighbour is that neighbour's value
    itself, so that rounding of x + (v - x) cannot let it in.
    """
    far = F.lit(float("inf"))
    steps = range(1, NEIGHBOURS + 1)
    gaps = points.withColumns(
        {f"_p{j}": F.coalesce(F.col("x") - F.col(f"_prev{j}"), far) for j in steps}
        | {f"_n{j}": F.coalesce(F.col(f"_next{j}") - F.col("x"), far) for j in steps}
        | {"k": F.least(F.lit(NEIGHBOURS).cast("long"), F.col("class_size") - 1)})

    def kth(k: int) -> Column:
        mixed = [F.greatest(F.col(f"_p{i}"), F.col(f"_n{k - i}")) for i in range(1, k)]
        return F.least(F.col(f"_p{k}"), F.col(f"_n{k}"), *mixed)

    radius = F.when(F.col("k") >= NEIGHBOURS, kth(NEIGHBOURS))
    for j in range(NEIGHBOURS - 1, 0, -1):
        radius = radius.when(F.col("k") == j, kth(j))
    ranged = gaps.withColumn("_r", radius)

    def end(side: str, gap: str, otherwise: Column) -> Column:
        exact = [F.when(F.col(f"{gap}{j}") == F.col("_r"), F.col(f"{side}{j}")) for j in steps]
        return F.coalesce(*exact, otherwise)

    return ranged.select(*KEYS, "sample_id", "x", "k", "class_size",
                         end("_prev", "_p", F.col("x") - F.col("_r")).alias("lo"),
                         end("_next", "_n", F.col("x") + F.col("_r")).alias("hi"))


def _prepared(cells: DataFrame, buckets: int) -> DataFrame:
    """(KEYS, sample_id, label, x, class_size): x is the value in units of its feature's deviation, plus a tiny amount fixed by the sample id.

    The unit of a feature does not matter, then; one without deviation keeps its values. The amount gives repeated values an
    order. Members of one-row classes are dropped.
    """
    present = cells.where(F.col("value").isNotNull()).select(*KEYS, "sample_id", "label", "value")
    facts = {"_mean": F.avg(F.abs("value")), "_spread": F.stddev_pop("value")}
    if buckets <= 1:
        # one shuffle by feature (the one of `train_cells`, if the cells come from there); every later step of the
        # unbucketed path keeps that partitioning
        sized = (present
                 .withColumns({name: fact.over(Window.partitionBy(*KEYS)) for name, fact in facts.items()})
                 .withColumn("class_size", F.count("*").over(Window.partitionBy(*KEYS, "label"))))
    else:
        present = cut_lineage(present)
        means = present.groupBy(*KEYS).agg(*(fact.alias(name) for name, fact in facts.items()))
        sizes = present.groupBy(*KEYS, "label").agg(F.count("*").alias("class_size"))
        sized = (present.join(broadcast_if_bounded(means), KEYS)
                 .join(broadcast_if_bounded(sizes), [*KEYS, "label"]))
    unit = F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(1.0)
    noise = F.lit(JITTER) * F.greatest(F.lit(1.0), F.col("_mean") / unit) * unit_hash(F.col("sample_id"))
    return (sized.where(F.col("class_size") > 1)
            .select(*KEYS, "sample_id", "label", (F.col("value") / unit + noise).alias("x"), "class_size"))


@scorer("mutual_info")
def mutual_information(cells: DataFrame, buckets: int = 1) -> DataFrame:
    """(cohort, seed, feature, score) from dense training cells (KEYS, sample_id, label, value).

    `buckets` > 1 spreads each single feature over that many tasks, for features with more samples than
    one task should sort; `ranking.buckets_for` suggests a number. The result is the same.
    """
    points = _prepared(cells, buckets)
    if buckets > 1:
        # both tables are read twice, by the quantile sketch and by the windows
        points = ranking.with_value_bucket(cut_lineage(points), KEYS, "x", buckets)
    bounds = _intervals(_class_neighbours(points, buckets > 1))
    if buckets > 1:
        bounds = cut_lineage(bounds)

    # at equal positions a high end comes before the values there (it excludes them), a low end after
    def entry(at: str, kind: int, is_value: int, sign: int):
        return F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"),
                        F.lit(is_value).cast("long").alias("one"), F.lit(sign).cast("long").alias("sign"))

    entries = bounds.select(*KEYS, "sample_id", "k", "class_size", F.inline(F.array(
        entry("hi", 0, 0, 1), entry("x", 1, 1, 0), entry("lo", 2, 0, -1))))
    if buckets > 1:
        entries = ranking.with_value_bucket(entries, KEYS, "at", buckets,
                                            cuts_from=entries.where(F.col("kind") == 1))
    counted = ranking.running_total(entries, KEYS, ["at", "kind"], F.col("one"), "below", bucketed=buckets > 1)
    closer = F.greatest(F.lit(1).cast("long"), F.sum(F.col("sign") * F.col("below")))
    per_point = counted.groupBy(*KEYS, "sample_id", "k", "class_size").agg(closer.alias("m"))
    estimate = (digamma(F.count("*")) + F.avg(digamma(F.col("k"))) - F.avg(digamma(F.col("class_size")))
                - F.avg(digamma(F.col("m"))))
    return per_point.groupBy(*KEYS).agg(F.greatest(F.lit(0.0), estimate).alias("score"))
