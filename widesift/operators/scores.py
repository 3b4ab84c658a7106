"""Filter scores per (cohort, seed, feature), and the registry through which a user adds one.

A scorer takes the pooled moments (or whatever its caller passes) and returns
(cohort, seed, feature, score). Scores are null where they are undefined, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from widesift.operators.splits import literal_rows

KEYS = ["cohort", "seed", "feature"]
Scorer = Callable[..., DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Registers a score function under a name, for use by the benchmark flows."""
    def register(function: Scorer) -> Scorer:
        SCORERS[name] = function
        return function
    return register


def population_variance() -> Column:
    return (F.col("between") + F.col("within")) / F.col("n")


@scorer("variance")
def variance_scores(moments: DataFrame) -> DataFrame:
    return moments.select(*KEYS, population_variance().alias("score"))


@scorer("anova")
def anova_scores(moments: DataFrame) -> DataFrame:
    """One-way ANOVA F. No spread inside the classes gives +inf, or null where there is none at all.

    "No spread" is a share of the total within rounding error, so that it does not hang on summation order.
    """
    between = F.col("between") / (F.col("k") - 1)
    within = F.col("within") / (F.col("n") - F.col("k"))
    undefined = (F.col("k") < 2) | (F.col("n") <= F.col("k")) | (F.col("hi") == F.col("lo"))
    return moments.select(*KEYS, F.when(undefined, F.lit(None).cast("double"))
                          .when(F.col("within") <= 1e-12 * (F.col("between") + F.col("within")), F.lit(float("inf")))
                          .otherwise(between / within).alias("score"))


def variance_sweep(moments: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(cohort, seed, threshold, n_features_total, n_features) for every threshold in one pass."""
    return (variance_scores(moments)
            .select("cohort", "seed", "score", literal_rows("threshold", [float(t) for t in thresholds]))
            .groupBy("cohort", "seed", "threshold")
            .agg(F.count("*").alias("n_features_total"),
                 F.count(F.when(F.col("score") > F.col("threshold"), 1)).alias("n_features")))


def varying_features(moments: DataFrame) -> DataFrame:
    """Features with two different training values; the test is on min and max, so no rounding enters."""
    return moments.where(F.col("hi") > F.col("lo")).select(*KEYS)
