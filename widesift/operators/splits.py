"""Seeds, job grids, stratified hold-out splits and stratified folds.

A seed is a row value, never a loop: one plan produces the splits of every cohort and seed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from widesift.operators import ranking

HOLDOUT_SHARE = 0.3


def consecutive_seeds(base: int = 42, runs: int = 10) -> list[int]:
    return list(range(base, base + runs))


def random_seeds(base: int = 42, runs: int = 10) -> list[int]:
    """Seeds drawn from numpy's default generator, 0 <= seed < 2**31 - 1."""
    return [int(s) for s in np.random.default_rng(base).integers(0, 2**31 - 1, size=runs)]


def seed_table(spark: SparkSession, base: int = 42, runs: int = 10) -> DataFrame:
    """(run_id, seed): run numbers from 0 and the seed of each run."""
    return spark.range(runs).select(F.col("id").cast("int").alias("run_id"),
                                    (F.col("id") + base).cast("int").alias("seed"))


def literal_rows(column: str, values: Sequence) -> Column:
    """A short parameter list as one output row per value (an explode, so no join is planned)."""
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(column)


def job_grid(cohorts: DataFrame, seeds: Sequence[int], methods: dict[str, Sequence[str]]) -> DataFrame:
    """cohort x seed x method x param, with run numbers, from a distinct cohort list."""
    pairs = [F.struct(F.lit(m).alias("method"), F.lit(p).alias("param"))
             for m, params in methods.items() for p in params]
    runs = F.array(*[F.struct(F.lit(i).alias("run_id"), F.lit(int(s)).alias("seed"))
                     for i, s in enumerate(seeds)])
    return (cohorts.select("cohort").distinct()
            .select("cohort", F.explode(runs).alias("r"))
            .select("cohort", "r.run_id", "r.seed", F.explode(F.array(*pairs)).alias("m"))
            .select("cohort", "run_id", "seed", "m.method", "m.param"))


def _hash_order(salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt), F.col("seed").cast("string"), F.lit(":"), F.col("sample_id")))


def train_quotas(samples: DataFrame, share: float = HOLDOUT_SHARE) -> DataFrame:
    """(cohort, label, size, quota): how many rows of each class go to the training part.

    ceil(share * n) rows are held out in all. Class quotas are proportional, and the rows lost to
    rounding go to the classes with the largest remainders. A class of one row is always trained on.
    """
    by_cohort = Window.partitionBy("cohort")
    lone = F.col("size") == 1
    sized = samples.groupBy("cohort", "label").agg(F.count("*").alias("size"))
    budget = (sized
              .withColumn("_lone", F.sum(lone.cast("long")).over(by_cohort))
              .withColumn("_all", F.sum("size").over(by_cohort))
              .withColumn("_rows", F.col("_all") - F.col("_lone"))
              .withColumn("_train", F.col("_all") - F.ceil(F.lit(share) * F.col("_all")) - F.col("_lone"))
              .withColumn("_part", F.when(lone, 0).otherwise(F.col("size").cast("decimal(38,0)") * F.col("_train")))
              .withColumn("_base", F.when(lone, 0).otherwise(F.expr("_part div _rows")).cast("long"))
              .withColumn("_left", F.when(lone, -1).otherwise(F.expr("_part % _rows")).cast("long")))
    by_remainder = by_cohort.orderBy(F.col("_left").desc(), "label")
    short = F.col("_train") - F.sum("_base").over(by_cohort)
    extra = (F.row_number().over(by_remainder) <= short).cast("long")
    return budget.select("cohort", "label", "size",
                         F.when(lone, 1).otherwise(F.col("_base") + extra).cast("long").alias("quota"))


def stratified_split(samples: DataFrame, seeds: Sequence[int], share: float = HOLDOUT_SHARE) -> DataFrame:
    """(cohort, seed, sample_id, label, part) for all seeds at once.

    Rows of a class are taken in the order of a hash of seed and id. The hash is uniform, so its first
    two digits cut any class, however large, into 256 even pieces that are numbered independently; the
    class quota travels with the piece offsets, so the rows are shuffled once.
    """
    keys = ["cohort", "seed", "label"]
    hashed = (samples.select("cohort", "sample_id", "label", literal_rows("seed", list(map(int, seeds))))
              .withColumn("_h", _hash_order(""))
              .withColumn(ranking.BUCKET, F.substring("_h", 1, 2)))
    spread = [*keys, ranking.BUCKET]
    offsets = (ranking.bucket_offsets(hashed, keys, F.lit(1).cast("long"))
               .join(train_quotas(samples, share).select("cohort", "label", "quota"), ["cohort", "label"]))
    place = F.row_number().over(Window.partitionBy(*spread).orderBy("_h", "sample_id"))
    return (hashed.withColumn("_place", place).join(offsets, spread)
            .select("cohort", "seed", "sample_id", "label",
                    F.when(F.col("_place") + F.col("_before") <= F.col("quota"), "train")
                    .otherwise("test").alias("part")))


def stratified_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Adds `fold` (0 .. folds-1) to (cohort, seed, sample_id, label) rows, dealt out per class."""
    keys = ["cohort", "seed", "label"]
    hashed = (rows.withColumn("_h", _hash_order("fold:"))
              .withColumn(ranking.BUCKET, F.substring("_h", 1, 2)))
    dealt = ranking.numbered(hashed, keys, ["_h", "sample_id"], "_n", bucketed=True)
    return dealt.withColumn("fold", ((F.col("_n") - 1) % folds).cast("int")).drop("_h", "_n")
