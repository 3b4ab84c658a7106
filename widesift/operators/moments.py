"""Per-feature statistics: the one aggregation behind every filter score and the scaler.

Variance threshold, ANOVA F, the top-variance pre-filter and standard scaling are all functions of
(n, mean, M2) per cohort, seed, feature and class. They are computed once, in one shuffle, for all
seeds and every later threshold, k or fraction.

A matrix is long: (cohort, sample_id, feature, value). Null values are missing; a sparse matrix simply
leaves out its zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from widesift.session import broadcast_if_bounded

#: eight fields a seed: from 13 on the aggregation would leave generated code
SEEDS_PER_PASS = 12


def class_sizes(splits: DataFrame, part: str = "train") -> DataFrame:
    """(cohort, seed, label, size) of one part of the split."""
    return (splits.where(F.col("part") == part)
            .groupBy("cohort", "seed", "label").agg(F.count("*").alias("size")))


def _train_masks(splits: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One row per sample, with one bit per seed that trains on it.

    Joining this instead of the split table keeps the matrix from being multiplied by the seeds.
    """
    position = "shiftleft(1L, cast(array_position(array({}), seed) - 1 as int))".format(
        ",".join(str(int(s)) for s in seeds))
    return (splits.where((F.col("part") == "train") & F.col("seed").isin([int(s) for s in seeds]))
            .groupBy("cohort", "sample_id", "label")
            .agg(F.bit_or(F.expr(position)).alias("_mask")))


def feature_stats(matrix: DataFrame, splits: DataFrame, seeds: Sequence[int],
                  samples: DataFrame | None = None) -> DataFrame:
    """(cohort, seed, feature, label, n, mean, m2, lo, hi) over the training rows of every seed.

    `samples` is a cheap DataFrame with at least one row per sample (the label table); it only serves
    the size check of the broadcast.
    """
    passes = [list(seeds[i:i + SEEDS_PER_PASS]) for i in range(0, len(seeds), SEEDS_PER_PASS)]
    return reduce(DataFrame.unionByName, [_stats_pass(matrix, splits, p, samples) for p in passes])


def _stats_pass(matrix, splits, seeds, samples):
    masks = _train_masks(splits, seeds)
    rows = matrix.select("cohort", "sample_id", "feature", "value").join(
        broadcast_if_bounded(masks, samples), ["cohort", "sample_id"])
    aggregates, outputs = [], []
    for i, seed in enumerate(seeds):
        value = f"IF((_mask & {1 << i}L) != 0, value, NULL)"
        aggregates += [F.expr(f"{call}({value}) AS {name}{i}") for call, name in (
            ("count", "n"), ("avg", "mean"), ("var_pop", "var"), ("min", "lo"), ("max", "hi"))]
        outputs.append(f"named_struct('seed', {int(seed)}, 'n', n{i}, 'mean', mean{i}, 'm2', var{i} * n{i}, 'lo', lo{i}, 'hi', hi{i})")
    return (rows.groupBy("cohort", "feature", "label").agg(*aggregates)
            .select("cohort", "feature", "label", F.expr(f"explode(array({', '.join(outputs)}))").alias("s"))
            .where(F.col("s.n") > 0)
            .select("cohort", "s.seed", "feature", "label", "s.n", "s.mean", "s.m2", "s.lo", "s.hi"))


def feature_moments(stats: DataFrame, sizes: DataFrame | None = None,
                    fill: DataFrame | None = None) -> DataFrame:
    """(cohort, seed, feature, n, k, mean, between, within, lo, hi): classes pooled per feature.

    With `sizes` (see `class_sizes`) the absent cells of a class count as a constant: 0, or the
    feature's `fill` value from (cohort, seed, feature, fill). The matrix is never densified; a group of
    equal values only shifts the mean and adds a known amount to M2.
    """
    keys = ["cohort", "seed", "feature"]
    over_classes = Window.partitionBy(*keys)
    if sizes is None:
        return (stats
                .withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(over_classes)
                            / F.sum("n").over(over_classes))
                .groupBy(*keys)
                .agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.any_value("_mean").alias("mean"),
                     F.sum(F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("between"),
                     F.sum("m2").alias("within"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    totals = sizes.groupBy("cohort", "seed").agg(F.sum("size").alias("_all"), F.count("*").alias("_k"))
    known = sizes.join(totals, ["cohort", "seed"])
    filled = stats.join(broadcast_if_bounded(known), ["cohort", "seed", "label"])
    if fill is None:
        filled = filled.withColumn("fill", F.lit(0.0))
    else:
        filled = filled.join(fill.select(*keys, "fill"), keys)
    share = F.col("n") / F.col("size")
    gap = F.col("mean") - F.col("fill")
    # measured from the fill value, absent cells are zeros; the spread between classes is taken around the pooled mean
    filled = (filled
              .withColumn("_m2", F.col("m2") + gap * gap * share * (F.col("size") - F.col("n")))
              .withColumn("_shift", gap * share))
    offset = F.sum(F.col("size") * F.col("_shift")).over(over_classes) / F.col("_all")
    filled = filled.withColumn("_offset", offset)
    pooled = filled.groupBy(*keys).agg(
        F.any_value("_all").alias("n"), F.any_value("_k").alias("k"), F.any_value("fill").alias("fill"),
        F.sum("n").alias("_present"), F.sum("size").alias("_seen"), F.any_value("_offset").alias("_offset"),
        F.sum(F.col("size") * (F.col("_shift") - F.col("_offset")) ** 2).alias("_squares"),
        F.sum("_m2").alias("within"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = F.col("_present") == F.col("n")
    # classes without a single cell lie at the fill value
    absent = (F.col("n") - F.col("_seen")) * F.col("_offset") ** 2
    return pooled.select(
        *keys, "n", "k", (F.col("fill") + F.col("_offset")).alias("mean"), (F.col("_squares") + absent).alias("between"), "within",
        F.when(whole, F.col("lo")).otherwise(F.least("lo", "fill")).alias("lo"),
        F.when(whole, F.col("hi")).otherwise(F.greatest("hi", "fill")).alias("hi"))
