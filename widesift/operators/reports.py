"""Summaries and comparisons over the run table (one row per cohort, method, param and seed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

METRICS = ["accuracy", "macro_f1", "weighted_f1", "macro_recall", "weighted_recall",
           "roc_auc_macro", "roc_auc_weighted"]
TIMES = ["train_time_s", "run_time_s"]
SETTING = ["cohort", "method", "param"]

RUN_SCHEMA = ("cohort string, method string, param string, seed int, run_id int, n_features_total int, "
              "n_features int, accuracy double, macro_f1 double, weighted_f1 double, macro_recall double, "
              "weighted_recall double, roc_auc_macro double, roc_auc_weighted double, train_time_s double, "
              "run_time_s double, status string")

# Headings of older run files, and the names their methods go by now.
OLD_HEADINGS = {
    "Cancer": "cohort",
    "Dataset": "cohort",
    "Method": "method",
    "Seed": "seed",
    "RunID": "run_id",
    "run": "run_id",
    "Original Features": "n_features_total",
    "Selected Features": "n_features",
    "Accuracy": "accuracy",
    "Macro F1": "macro_f1",
    "Weighted F1": "weighted_f1",
    "ROC-AUC": "roc_auc",
    "Runtime (s)": "run_time_s",
    "train_time": "train_time_s",
}
# Headings of a method's parameter, and what the parameter is called by now.
OLD_PARAMETERS = {
    "Threshold": "threshold",
    "Top K": "k",
    "Feature Fraction": "fraction",
}
#: the only area of older files is the weighted average in these methods' files and the macro average in all others
WEIGHTED_AREA = ("baseline", "LASSO", "RandomForest")
OLD_METHOD_NAMES = {
    "ANOVA / F-test": "ANOVA",
    "Random Forest": "RandomForest",
}


def available(runs: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in runs.columns]


def unpivot_metrics(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    return runs.unpivot(list(keys), available(runs, metrics), "metric", "value")


def aggregate_runs(runs: DataFrame, keys: Sequence[str] = SETTING,
                   metrics: Sequence[str] | None = None) -> DataFrame:
    """`<metric>_mean/_std/_min/_max` of the metrics the table has, `n_runs` distinct runs and `n_rows`."""
    wanted = available(runs, metrics or [*METRICS, *TIMES, "n_features"])
    stats = [f(m).alias(f"{m}_{name}") for m in wanted
             for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return runs.groupBy(*keys).agg(*stats, F.count_distinct("run_id").alias("n_runs"),
                                   F.count("*").alias("n_rows"))


def reported(summary: DataFrame) -> DataFrame:
    """The summary as printed: the deviation of a single run shows as 0."""
    return summary.na.fill(0.0, [c for c in summary.columns if c.endswith("_std")])


def mean_std(runs: DataFrame, keys: Sequence[str] = ("cohort", "method")) -> DataFrame:
    """Mean and sample deviation only, for metrics, feature count and training time."""
    wanted = available(runs, [*METRICS, "n_features", "train_time_s"])
    return runs.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in wanted
                                     for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def summary_long(runs: DataFrame) -> DataFrame:
    """(method, cohort, metric, mean, std, min, max), sample deviation."""
    return unpivot_metrics(runs, ["method", "cohort"]).groupBy("method", "cohort", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def compare_methods(runs: DataFrame, by_cohort: bool) -> DataFrame:
    """([cohort,] method, metric, mean, std_pop): pooled over cohorts, or per cohort."""
    keys = ["cohort", "method"] if by_cohort else ["method"]
    return unpivot_metrics(runs, keys).groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"))


def feature_counts(runs: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean selected-feature count per cohort and listed method, 0 where the method has no run."""
    grid = (runs.select("cohort").distinct()
            .select("cohort", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")))
    means = runs.groupBy("cohort", "method").agg(F.avg("n_features").alias("n_features"))
    return (grid.join(means, ["cohort", "method"], "left")
            .withColumn("n_features", F.coalesce("n_features", F.lit(0.0))))


def describe_runs(runs: DataFrame, keys: Sequence[str] = ("cohort",)) -> DataFrame:
    """(keys, metric, count, mean, std, min, p25, p50, p75, max)"""
    return unpivot_metrics(runs, keys).groupBy(*keys, "metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), *[F.percentile("value", q / 100).alias(f"p{q}") for q in (25, 50, 75)],
        F.max("value").alias("max"))


def total_times(runs: DataFrame, keys: Sequence[str] = ("cohort", "method")) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.sum(t).alias(f"{t}_total") for t in available(runs, TIMES)],
                                   F.count("*").alias("n_rows"))


def best_setting(runs: DataFrame, keys: Sequence[str] = ("cohort", "method"),
                 highest: Sequence[str] = ("accuracy", "macro_f1", "roc_auc_macro"),
                 lowest: Sequence[str] = ("run_time_s",)) -> DataFrame:
    """(keys, criterion, param, seed, value): best row per criterion; ties go to the first param, then seed."""
    criteria = runs.select(*keys, "param", "seed", *highest, *[(-F.col(c)).alias(c) for c in lowest])
    long = criteria.unpivot([*keys, "param", "seed"], [*highest, *lowest], "criterion", "_v")
    best = F.min(F.struct((-F.col("_v")).alias("_d"), "param", "seed", "_v"))
    value = F.when(F.col("criterion").isin(list(lowest)), -F.col("b._v")).otherwise(F.col("b._v"))
    return (long.where(F.col("_v").isNotNull()).groupBy(*keys, "criterion").agg(best.alias("b"))
            .select(*keys, "criterion", "b.param", "b.seed", value.alias("value")))


def prefer_new(new: DataFrame, old: DataFrame) -> DataFrame:
    """All new runs, and the old runs of cohorts that were not run again."""
    kept = old.join(new.select("cohort").distinct(), "cohort", "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def canonical(runs: DataFrame) -> DataFrame:
    """Current column and method names for a run table with older ones.

    A parameter of its own heading becomes `param`, written as present runs write it; `all` stands for none. An area
    under the single name roc_auc is also given under the name of the average it is.
    """
    known = {k: v for k, v in OLD_HEADINGS.items() if k in runs.columns and (v not in runs.columns or k == v)}
    named = runs.withColumnsRenamed(known)
    if "method" in named.columns:
        named = named.replace(OLD_METHOD_NAMES, subset=["method"])
    if "param" not in named.columns:
        given = [F.when(F.col(f"`{k}`").isNotNull(), F.concat(F.lit(f"{name}="), _short(F.col(f"`{k}`"))))
                 for k, name in OLD_PARAMETERS.items() if k in named.columns]
        named = named.withColumn("param", F.coalesce(*given, F.lit("all"))).drop(*OLD_PARAMETERS)
    if "roc_auc" in named.columns and not available(named, ["roc_auc_macro", "roc_auc_weighted"]):
        weighted = F.col("method").isin(*WEIGHTED_AREA) if "method" in named.columns else F.lit(False)
        area = F.expr("try_cast(roc_auc AS double)")
        named = named.withColumns({"roc_auc_weighted": F.when(weighted, area), "roc_auc_macro": F.when(~weighted, area)})
    return named


def _short(number: Column) -> Column:
    """A number as text without closing zeros: 0.50 is 0.5, 2000.0 is 2000."""
    text = number.cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def sweep_series(runs: DataFrame, method: str) -> DataFrame:
    """Metrics and feature counts of one method by its parameter: the data behind a sweep chart."""
    return (runs.where(F.col("method") == method)
            .select("cohort", "param", "seed", "n_features", *available(runs, METRICS))
            .orderBy("cohort", "param", "seed"))


def per_run_series(runs: DataFrame) -> DataFrame:
    """(cohort, method, param, run_id, metric, value), one row per point of a per-run line chart."""
    return unpivot_metrics(runs, [*SETTING, "run_id"])


def run_records(grid: DataFrame, feature_sets: DataFrame, metrics: DataFrame, n_features_total: DataFrame,
                times: DataFrame | None = None) -> DataFrame:
    """Rows in the run schema for every grid cell; a cell without features keeps null metrics.

    grid: (cohort, run_id, seed, method, param); feature_sets: the same keys (without run_id) and feature;
    n_features_total: (cohort, n_features_total).
    """
    keys = ["cohort", "seed", "method", "param"]
    counts = feature_sets.groupBy(*keys).agg(F.count("*").cast("int").alias("n_features"))
    rows = (grid.join(n_features_total, "cohort", "left").join(counts, keys, "left")
            .withColumn("n_features", F.coalesce("n_features", F.lit(0))).join(metrics, keys, "left"))
    if times is not None:
        rows = rows.join(times, keys, "left")
    none = F.lit(None).cast("double")
    for name in TIMES:
        if name not in rows.columns:
            rows = rows.withColumn(name, none)
    outcome = F.when(F.col("accuracy").isNull(), "empty").otherwise("ok")
    rows = rows.withColumn("status", F.coalesce("status", outcome) if "status" in rows.columns else outcome)
    names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
    return rows.withColumn("n_features_total", F.col("n_features_total").cast("int")).select(*names)
