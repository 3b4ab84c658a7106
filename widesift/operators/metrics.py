"""Evaluation of a predictions table.

Predictions are (run keys..., sample_id, label, prediction, proba map<string,double>). Everything but
the ROC curve follows from the confusion counts, which are K x K rows per run whatever the test size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from widesift.functions.columns import clean_probability, safe_ratio
from widesift.operators import ranking

RUN_KEYS = ["cohort", "seed", "method", "param"]


# ---- probabilities ----------------------------------------------------------------------------

def clean_probabilities(long: DataFrame) -> DataFrame:
    """On (..., sample_id, class, p): non-finite probabilities replaced."""
    return long.withColumn("p", clean_probability(F.col("p")))


def normalise_probabilities(long: DataFrame, keys: list[str]) -> DataFrame:
    """Probabilities of a sample divided by their sum; a sample whose sum is 0 keeps its zeros."""
    total = F.sum("p").over(Window.partitionBy(*keys, "sample_id"))
    return long.withColumn("p", F.col("p") / F.when(total == 0, 1.0).otherwise(total))


def softmax_scores(long: DataFrame, keys: list[str]) -> DataFrame:
    """On (..., sample_id, class, score): adds p, the softmax over the classes of a sample."""
    sample = Window.partitionBy(*keys, "sample_id")
    power = F.exp(F.col("score") - F.max("score").over(sample))
    return long.withColumn("_e", power).withColumn("p", F.col("_e") / F.sum("_e").over(sample)).drop("_e")


def predictions_from_scores(long: DataFrame, keys: list[str]) -> DataFrame:
    """Class scores to predictions: highest score wins (ties: first class), softmax gives `proba`.

    The scores of one sample, one per class, meet in one row, so this is a single shuffle.
    """
    best = F.min(F.struct(-F.col("score"), F.col("class")))["class"]
    rows = long.groupBy(*keys, "sample_id", "label").agg(
        best.alias("prediction"), F.max("score").alias("_top"),
        F.array_sort(F.collect_list(F.struct("class", "score"))).alias("_s"))
    powers = F.transform("_s", lambda s: F.struct(s["class"].alias("class"),
                                                  F.exp(s["score"] - F.col("_top")).alias("e")))
    total = F.aggregate("_e", F.lit(0.0), lambda acc, s: acc + s["e"])
    return (rows.withColumn("_e", powers).withColumn("_sum", total)
            .select(*keys, "sample_id", "label", "prediction", F.map_from_entries(F.transform(
                "_e", lambda s: F.struct(s["class"], s["e"] / F.col("_sum")))).alias("proba")))


# ---- counts -----------------------------------------------------------------------------------

def confusion_counts(predictions: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """(keys, label, prediction, n) of the combinations that occur."""
    return predictions.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """(keys, label, prediction, n) for every pair of classes of the key, zeros included.

    Leave `seed` out of the keys to sum the matrices of all runs.
    """
    counts = confusion_counts(predictions, keys)
    classes = counts.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(
        F.collect_set(F.array("label", "prediction"))))).alias("_classes"))
    grid = (classes.select(*keys, "_classes", F.explode("_classes").alias("label"))
            .select(*keys, "label", F.explode("_classes").alias("prediction")))
    return (grid.join(counts, [*keys, "label", "prediction"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def confusion_wide(predictions: DataFrame, classes: list[str], keys: list[str] = RUN_KEYS) -> DataFrame:
    """The same with one column per predicted class, for a known class list."""
    return (confusion_matrix(predictions, keys).groupBy(*keys, "label")
            .pivot("prediction", classes).agg(F.sum("n")).na.fill(0))


def class_metrics(counts: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """(keys, class, tp, support, predicted, precision, recall, f1), classes true or predicted."""
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")))
    return (counts.select(*keys, F.inline(sides)).groupBy(*keys, "class")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
            .withColumn("precision", safe_ratio(F.col("tp"), F.col("predicted")))
            .withColumn("recall", safe_ratio(F.col("tp"), F.col("support")))
            .withColumn("f1", safe_ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def run_metrics(predictions: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """(keys, accuracy, macro_f1, weighted_f1, macro_recall, weighted_recall, n_test)"""
    per_class = class_metrics(confusion_counts(predictions, keys), keys)
    total = F.sum("support")
    return per_class.groupBy(*keys).agg(
        (F.sum("tp") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        F.avg("recall").alias("macro_recall"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("weighted_recall"),
        total.alias("n_test"))


def class_report(predictions: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """(keys, class, precision, recall, f1, support): one row per class, then accuracy and two averages."""
    per_class = class_metrics(confusion_counts(predictions, keys), keys)
    total = F.sum("support")

    def summary(kind, precision, recall, f1):
        return F.struct(F.lit(kind).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), total.alias("support"))

    def weighted(name):
        return F.sum(F.col(name) * F.col("support")) / total

    nothing = F.lit(None).cast("double")
    accuracy = F.sum("tp") / total
    rows = per_class.groupBy(*keys).agg(F.array(
        summary("accuracy", nothing, nothing, accuracy),
        summary("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
        summary("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"))).alias("_s"))
    return (per_class.select(*keys, "class", "precision", "recall", "f1", "support")
            .unionByName(rows.select(*keys, F.inline("_s"))))


# ---- ROC --------------------------------------------------------------------------------------

def score_auc(scored: DataFrame, keys: list[str], buckets: int = 1) -> DataFrame:
    """(keys, n_pos, n_neg, auc) from (keys, positive boolean, score); null when a side is empty.

    Rows are first folded to one per distinct score (as an exact double), then negatives are counted in score order; a
    positive beats the negatives below it and half of those it ties with. `buckets` > 1 spreads the
    counting of one key over that many tasks.
    """
    folded = (scored.groupBy(*keys, "score")
              .agg(F.count_if("positive").alias("_pos"), F.count_if(~F.col("positive")).alias("_neg")))
    if buckets > 1:
        folded = ranking.with_value_bucket(folded, keys, "score", buckets)
    ordered = ranking.running_total(folded, keys, ["score"], F.col("_neg"), "_upto", bucketed=buckets > 1)
    wins = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    return (ordered.groupBy(*keys)
            .agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), wins.alias("_wins"))
            .select(*keys, "n_pos", "n_neg",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                           F.col("_wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc")))


def class_auc(predictions: DataFrame, keys: list[str] = RUN_KEYS, buckets: int = 1) -> DataFrame:
    """One-vs-rest area per class: (keys, class, n_pos, n_neg, auc)."""
    long = predictions.select(*keys, "label", F.explode("proba").alias("class", "p"))
    scored = long.select(*keys, "class", (F.col("label") == F.col("class")).alias("positive"),
                         clean_probability(F.col("p")).alias("score"))
    return score_auc(scored, [*keys, "class"], buckets)


def average_auc(per_class: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """(keys, roc_auc_macro, roc_auc_weighted); null when a class has no area. Two classes: the second's."""
    defined = F.count("auc") == F.count("*")
    binary = F.count("*") == 2
    second = F.max(F.struct("class", "auc"))["auc"]
    weighted = F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")
    return per_class.groupBy(*keys).agg(
        F.when(~defined, None).when(binary, second).otherwise(F.avg("auc")).alias("roc_auc_macro"),
        F.when(~defined, None).when(binary, second).otherwise(weighted).alias("roc_auc_weighted"))


def evaluate(predictions: DataFrame, keys: list[str] = RUN_KEYS, buckets: int = 1) -> DataFrame:
    """All run metrics in one row per key."""
    return run_metrics(predictions, keys).join(
        average_auc(class_auc(predictions, keys, buckets), keys), keys)
