"""From raw readings and label rows to an aligned long matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from widesift.functions.columns import nan_to_null, patient_id
from widesift.session import broadcast_if_bounded


def prepare_labels(raw: DataFrame, id_col: str, label_col: str, position_col: str,
                   id_length: int = 12) -> DataFrame:
    """(cohort, sample_id, label): incomplete rows dropped, ids cut to the patient, first row per patient.

    "First" is by `position_col`, the row's place in the file, because Spark rows have no order. The
    first row is an aggregate minimum, so a patient with very many rows is reduced before the shuffle.
    """
    kept = complete_labels(raw, id_col, label_col, [position_col], id_length)
    first = F.min(F.struct(position_col, "label"))["label"]
    return kept.groupBy("cohort", "sample_id").agg(first.alias("label"))


def complete_labels(raw: DataFrame, id_col: str, label_col: str, extra: list[str] | None = None,
                    id_length: int = 12) -> DataFrame:
    """The two label columns without incomplete rows, ids cut to the patient; repeated ids stay."""
    return (raw.select("cohort", F.col(id_col).alias("_id"), F.col(label_col).alias("label"), *(extra or []))
            .na.drop("any", subset=["_id", "label"])
            .withColumn("sample_id", patient_id("_id", id_length)).drop("_id"))


def average_duplicates(readings: DataFrame, id_col: str = "barcode", id_length: int = 12) -> DataFrame:
    """(cohort, sample_id, feature, value): mean over the readings of a patient; NaN counts as missing."""
    return (readings
            .select("cohort", patient_id(id_col, id_length).alias("sample_id"), "feature",
                    nan_to_null(F.col("value")).alias("value"))
            .groupBy("cohort", "sample_id", "feature").agg(F.avg("value").alias("value")))


def align(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of the samples that have a label, with the label. Repeated ids on either side multiply."""
    return matrix.join(broadcast_if_bounded(labels.select("cohort", "sample_id", "label")),
                       ["cohort", "sample_id"])


def common_samples(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the samples that occur in the matrix."""
    present = matrix.select("cohort", "sample_id").distinct()
    return labels.join(present, ["cohort", "sample_id"], "left_semi")


def class_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cohort", "label").agg(F.count("*").alias("n"))


def drop_class(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col("label") != label)


def drop_rare_classes(labels: DataFrame, min_size: int) -> DataFrame:
    """Samples whose class has at least `min_size` members in its cohort."""
    enough = class_distribution(labels).where(F.col("n") >= min_size)
    return labels.join(broadcast_if_bounded(enough), ["cohort", "label"], "left_semi")


def matrix_shape(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """(cohort, n_samples, n_features, n_labelled, n_common)"""
    cells = matrix.groupBy("cohort").agg(F.count_distinct("sample_id").alias("n_samples"),
                                         F.count_distinct("feature").alias("n_features"))
    labelled = labels.groupBy("cohort").agg(F.count("*").alias("n_labelled"))
    common = common_samples(matrix, labels).groupBy("cohort").agg(F.count("*").alias("n_common"))
    return cells.join(labelled, "cohort", "left").join(common, "cohort", "left").na.fill(0)


def label_index(labels: DataFrame) -> DataFrame:
    """Adds `label_index`, 0-based in alphabetical order of the cohort's classes."""
    classes = labels.groupBy("cohort").agg(F.array_sort(F.collect_set("label")).alias("_classes"))
    return (labels.join(broadcast_if_bounded(classes), "cohort")
            .withColumn("label_index", (F.array_position("_classes", F.col("label")) - 1).cast("int"))
            .drop("_classes"))


def to_float32(matrix: DataFrame) -> DataFrame:
    """Halves the width of the value column; statistics widen it again."""
    return matrix.withColumn("value", F.col("value").cast("float"))
