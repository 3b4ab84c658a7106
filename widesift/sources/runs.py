"""Run tables on disk: one file set per run, older layouts, and result sinks."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from widesift.operators import reports


def run_schema() -> StructType:
    return _parse_datatype_string(reports.RUN_SCHEMA)


def _typed(frame: DataFrame) -> DataFrame:
    """Columns of the run schema in their types (by name), other columns as they are."""
    kinds = {f.name: f.dataType for f in run_schema().fields}
    return frame.select([F.expr(f"try_cast(`{c}` AS {kinds[c].simpleString()})").alias(c) if c in kinds else F.col(f"`{c}`")
                         for c in frame.columns])


def _by_header(spark: SparkSession, pattern: str) -> list[DataFrame]:
    """One DataFrame, with the column _file, for each distinct header among the CSV files of a glob.

    Run files are few and their headers short, so the driver sorts the files by their first lines.
    """
    try:
        text = spark.read.text(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("line"))
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files"))
    reader = spark.read.option("header", True)
    return [reader.csv([unquote(f) for f in row["files"]]).select("*", F.col("_metadata.file_path").alias("_file"))
            for row in heads.orderBy("head").collect()]


def _united(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """Frames of different layouts by column name; columns that one of them lacks are null there."""
    if not frames:
        return spark.createDataFrame([], run_schema())
    return _typed(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """All run files matching a glob such as `.../runs/anova/run_*.csv`, whatever the order of their columns; none gives an empty table."""
    return _united(spark, [reports.canonical(f.drop("_file")) for f in _by_header(spark, pattern)])


def read_old_runs(spark: SparkSession, root: str, method: str) -> DataFrame:
    """Older results in <root>/<method>/<cohort>/<cohort>_run_results.csv.

    Cohort and method come from the directory names where the files do not have the columns.
    """
    def named(found: DataFrame) -> DataFrame:
        frame = reports.canonical(found.withColumns({"_cohort": F.regexp_extract("_file", "([^/]+)/[^/]+$", 1),
                                                     "_method": F.regexp_extract("_file", "([^/]+)/[^/]+/[^/]+$", 1)}).drop("_file"))
        for column in ("cohort", "method"):
            derived = F.col(f"_{column}")
            frame = frame.withColumn(column, F.coalesce(F.col(column), derived) if column in frame.columns else derived)
        return frame.drop("_cohort", "_method")

    return _united(spark, [named(f) for f in _by_header(spark, f"{root}/{method}/*/*_run_results.csv")])


def write_results(runs: DataFrame, folder: str, kind: str = "csv") -> None:
    """Result table, one directory per cohort."""
    _write(runs, folder, kind, ["cohort"])


def write_run_files(runs: DataFrame, folder: str, kind: str = "csv") -> None:
    """Run table, one directory per method and run number."""
    _write(runs, folder, kind, ["method", "run_id"])


def _write(runs: DataFrame, folder: str, kind: str, by: list[str]) -> None:
    writer = runs.repartition(*by).write.mode("overwrite").partitionBy(*by).format(kind)
    (writer.option("header", True) if kind == "csv" else writer).save(folder)
