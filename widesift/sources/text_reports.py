"""Plain-text reports. Every report is (position, line) rows, a few lines per setting, written in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from widesift.operators import reports

# Metric captions of the printed reports.
CAPTIONS = {
    "accuracy": "Accuracy",
    "macro_f1": "Macro F1",
    "weighted_f1": "Weighted F1",
    "macro_recall": "Macro Recall",
    "weighted_recall": "Weighted Recall",
    "roc_auc_macro": "ROC-AUC (macro)",
    "roc_auc_weighted": "ROC-AUC (weighted)",
    "n_features": "n_features",
    "train_time_s": "Train Time (s)",
    "run_time_s": "Run Time (s)",
}


def _lines(rows: DataFrame, order: list[str], lines: list[Column]) -> DataFrame:
    """The given lines for every row, rows sorted by `order`."""
    numbered = F.array(*[F.struct(F.lit(i).alias("_i"), line.alias("line")) for i, line in enumerate(lines)])
    return rows.select(*order, F.inline(numbered)).select(F.struct(*order, "_i").alias("position"), "line")


def aggregated_report(summary: DataFrame) -> DataFrame:
    """Mean, deviation, minimum and maximum of every metric, one block per setting."""
    shown = reports.reported(summary)
    lines = [F.format_string("  Cohort: %s  Method: %s  Param: %s", "cohort", "method", "param")]
    lines += [F.format_string(f"    {caption:<18} mean=%.4f  std=%.4f  min=%.4f  max=%.4f",
                              *[F.col(f"{m}_{k}").cast("double") for k in ("mean", "std", "min", "max")])
              for m, caption in CAPTIONS.items() if f"{m}_mean" in shown.columns]
    lines += [F.format_string("    n_runs             %d", "n_runs"), F.lit("")]
    return _lines(shown, ["cohort", "method", "param"], lines)


def run_report(runs: DataFrame, class_report: DataFrame) -> DataFrame:
    """The metrics of each run, then its per-class table. Both share (cohort, seed, method, param)."""
    keys = ["cohort", "method", "param", "seed"]
    head = [F.format_string("Report: %s on %s (%s, seed %d)", "method", "cohort", "param", "seed"),
            F.format_string("Features: %d", "n_features"), F.format_string("Training Time: %.2fs", "train_time_s")]
    head += [F.format_string(f"{CAPTIONS[m]}: %.4f", m) for m in reports.METRICS]
    head += [F.lit(""), F.lit(f"{'class':>14} {'precision':>10} {'recall':>10} {'f1-score':>10} {'support':>10}")]
    summaries = ["accuracy", "macro avg", "weighted avg"]
    place = F.coalesce(*[F.when(F.col("class") == s, F.lit(i + 1)) for i, s in enumerate(summaries)], F.lit(0))

    def cell(name: str) -> Column:
        return F.coalesce(F.format_string("%10.2f", name), F.lit(" " * 10)) if name == "f1" else F.when(
            F.col(name).isNull(), F.lit(" " * 10)).otherwise(F.format_string("%10.2f", name))

    body = class_report.select(
        F.struct(*keys, F.lit(1).alias("_part"), place.alias("_place"), F.col("class").alias("_class"), F.lit(0).alias("_i")).alias("position"),
        F.concat_ws(" ", F.format_string("%14s", "class"), cell("precision"), cell("recall"), cell("f1"),
                    F.format_string("%10d", "support")).alias("line"))
    top = runs.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), line.alias("line")) for i, line in enumerate(head)])))
    top = top.select(F.struct(*keys, F.lit(0).alias("_part"), F.lit(0).alias("_place"), F.lit("").alias("_class"), "_i").alias("position"), "line")
    return top.unionByName(body)


def metric_table(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Metric x (mean, std, min, max) per key, then the total times."""
    wanted = reports.available(runs, [*reports.METRICS, *reports.TIMES])
    summary = reports.reported(reports.aggregate_runs(runs, keys, wanted)).join(reports.total_times(runs, keys).drop("n_rows"), keys)
    lines = [F.concat_ws(" ", *keys), F.lit(f"{'Metric':<20} {'Mean':>10} {'Std':>10} {'Min':>10} {'Max':>10}"), F.lit("-" * 64)]
    lines += [F.format_string(f"{CAPTIONS[m]:<20} %10.4f %10.4f %10.4f %10.4f", *[F.col(f"{m}_{k}") for k in ("mean", "std", "min", "max")])
              for m in wanted]
    lines += [F.format_string(f"Total {CAPTIONS[t].lower()}: %.2f", f"{t}_total") for t in reports.TIMES if t in wanted] + [F.lit("")]
    return _lines(summary, keys, lines)


def best_settings_report(best: DataFrame) -> DataFrame:
    """One line per best setting."""
    return _lines(best, ["cohort", "method", "criterion"],
                  [F.format_string("[%s] %s best %s: %s (seed %d) = %.4f", "cohort", "method", "criterion", "param", "seed", "value")])


def write_report(lines: DataFrame, folder: str) -> None:
    """The report as one ordered text file. It is small by construction: a few lines per setting."""
    lines.repartition(1).sortWithinPartitions("position").select("line").write.mode("overwrite").text(folder)
