"""Turning a score table into feature sets, and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from widesift.functions.columns import feature_budget, significant
from widesift.operators import ranking
from widesift.session import broadcast_if_bounded, cut_lineage

GROUP = ["cohort", "seed"]
SCORE_DIGITS = 10
#: quantiles of the sketch that bounds a top-k
SKETCH_ACCURACY = 10_000
SKETCH = [i / 200 for i in range(1, 201)]


def ranked_scores(scores: DataFrame, higher_index_wins: bool = True, buckets: int = 1,
                  digits: int = SCORE_DIGITS) -> DataFrame:
    """Adds `rank` (1 = best) per cohort and seed: score descending, undefined scores last.

    Ties go to the feature later in column order (`feature` sorts in column order), or to the earlier one.
    Scores are compared to `digits` significant digits, so that neither their unit nor the order of a sum decides. `buckets` > 1
    spreads the ranking of one group over that many tasks.
    """
    tie = F.col("feature").desc() if higher_index_wins else F.col("feature").asc()
    known = scores.withColumn("_down", -F.coalesce(significant("score", digits), F.lit(float("-inf"))))
    order = [F.col("_down").asc(), tie]
    if buckets <= 1:
        rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))
        return known.withColumn("rank", rank).drop("_down")
    # read by the quantile sketch, the offsets and the ranking
    cut = ranking.with_value_bucket(cut_lineage(known), GROUP, "_down", buckets)
    return (ranking.numbered(cut, GROUP, order, "_n", bucketed=True)
            .withColumn("rank", F.col("_n").cast("int")).drop("_down", "_n"))


def top_k(scores: DataFrame, k: int, higher_index_wins: bool = True, buckets: int = 1,
          digits: int = SCORE_DIGITS) -> DataFrame:
    """The min(k, width) best features of each cohort and seed, with `rank`.

    With `buckets` > 1 a quantile sketch first gives a score that is surely among the best k and a little beyond, and
    only what reaches it is ranked; the ranking itself keeps k rows of each map task.
    """
    if buckets <= 1:
        return ranked_scores(scores, higher_index_wins, 1, digits).where(F.col("rank") <= k)
    scores = cut_lineage(scores)  # read by the sketch and the ranking
    down = -F.coalesce(F.col("score"), F.lit(float("-inf")))
    sizes = scores.groupBy(*GROUP).agg(F.count("*").alias("_n"), F.percentile_approx(down, SKETCH, SKETCH_ACCURACY).alias("_q"))
    # a quantile of the sketch is off by 1/accuracy of the rows at most
    place = F.ceil((F.lit(k) / F.col("_n") + 1.0 / SKETCH_ACCURACY) * len(SKETCH))
    bound = F.when(place < len(SKETCH), F.get("_q", place.cast("int"))).otherwise(F.lit(float("inf")))
    bounds = sizes.select(*GROUP, bound.alias("_bound"))
    # the bound is widened by more than rounding to significant digits can move a score
    slack = F.abs(F.col("_bound")) * 10.0 ** (2 - digits)
    near = scores.join(broadcast_if_bounded(bounds), GROUP).where(down <= F.col("_bound") + slack).drop("_bound")
    return ranked_scores(near, higher_index_wins, 1, digits).where(F.col("rank") <= k)


def top_fraction(scores: DataFrame, fractions: list[float], buckets: int = 1,
                 digits: int = SCORE_DIGITS) -> DataFrame:
    """For each fraction, the best max(1, int(width * fraction)) features, with `fraction` and `rank`."""
    ranked = ranked_scores(scores, True, buckets, digits)
    if buckets <= 1:
        sized = ranked.withColumn("_width", F.count("*").over(Window.partitionBy(*GROUP)))
    else:
        ranked = cut_lineage(ranked)
        widths = ranked.groupBy(*GROUP).agg(F.count("*").alias("_width"))
        sized = ranked.join(broadcast_if_bounded(widths), GROUP)
    return (sized.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
            .where(F.col("rank") <= feature_budget(F.col("_width"), F.col("fraction")))
            .drop("_width"))


def above(scores: DataFrame, threshold: float | Column) -> DataFrame:
    """Scores strictly above a threshold."""
    return scores.where(F.col("score") > threshold)


def above_mean(scores: DataFrame) -> DataFrame:
    """Scores strictly above the mean of the finite scores of their cohort and seed; an infinite score always is."""
    scores = cut_lineage(scores)
    finite = F.when(F.abs("score") < F.lit(float("inf")), F.col("score"))
    mean = scores.groupBy(*GROUP).agg(F.avg(finite).alias("_mean"))
    reached = (F.col("score") > F.col("_mean")) | (F.col("score") == F.lit(float("inf")))
    return scores.join(broadcast_if_bounded(mean), GROUP).where(reached & ~F.isnan("score")).drop("_mean")


def nonzero(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score") != 0)


def select_features(scores: DataFrame, mode: str, param: float | int | None = None, **options) -> DataFrame:
    """One entry point for all masks: top_k, fraction, threshold, gt_mean or nonzero."""
    if mode == "top_k":
        return top_k(scores, int(param), **options)
    if mode == "fraction":
        return top_fraction(scores, [float(param)], **options)
    if mode == "threshold":
        return above(scores, float(param))
    if mode == "gt_mean":
        return above_mean(scores)
    if mode == "nonzero":
        return nonzero(scores)
    raise ValueError(f"unknown selection mode {mode!r}")


def project_features(matrix: DataFrame, features: DataFrame) -> DataFrame:
    """Keeps the cells of selected features; adds the feature set's own keys (seed, method, param).

    In the long layout column pruning is a row filter. The feature sets are broadcast when they are
    small enough, so that the matrix is filtered where it is read.
    """
    on = [k for k in ("cohort", "seed", "feature") if k in matrix.columns]
    return matrix.join(broadcast_if_bounded(features), on)


def feature_list(selected: DataFrame, keys: list[str], out: str = "features") -> DataFrame:
    """One ';'-joined list per key in rank order (the list is the size of the feature set)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "feature")))
    return selected.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["feature"]), ";").alias(out),
        F.count("*").alias("n_features"))
