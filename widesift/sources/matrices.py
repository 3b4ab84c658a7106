"""Readers for wide matrices and label files, and the parquet form they are kept in.

A wide file becomes long rows while it is read. A DataFrame with one column per feature is never built:
planning cost grows with columns, and the CSV reader stops at 20,480 of them by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from widesift.functions.columns import nan_to_null
from widesift.session import broadcast_if_bounded, cut_lineage


def _existing(read: Callable[[], DataFrame], path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"data file not found: {path}") from error
        raise


def _cells(line: Column, separator: str) -> Column:
    """The cells of a text line; a separator within double quotes belongs to its cell, two quotes within them are one."""
    literal = "\\Q" + separator + "\\E"
    quoted = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(f'{literal}("(?:[^"]|"")*+"|(?:(?!{literal}).)*+)'), F.lit(1))
    plain = lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    cells = F.when(F.contains(line, F.lit('"')), F.transform(quoted, plain)).otherwise(F.split(line, literal, -1))
    return F.transform(cells, lambda c: F.trim(c))


def _wide_cells(spark: SparkSession, path: str, cohort: str, separator: str, tasks: int | None) -> DataFrame:
    """(cohort, row_id, column_id, column_pos, value) of text matrices; the first line of each file names its columns.

    A header is the first line of a file's first block, whatever it says; every file has its own. Cells beyond the
    header's width have no name and are left out. Empty lines are no rows.
    """
    text = _existing(lambda: spark.read.text(path), path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("line"))
    # one line of each file
    heads = cut_lineage(lines.where("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("value"), F.min("line").alias("line")))
    if heads.isEmpty():
        raise ValueError(f"empty matrix file: {path}")
    names = (heads.select("file", F.posexplode(_cells(F.col("value"), separator)).alias("pos", "column_id")).where("pos > 0"))
    first = heads.select("file", F.lit(0).cast("bigint").alias("block"), "line")
    rows = lines.join(broadcast_if_bounded(first, first), ["file", "block", "line"], "left_anti").where("value != ''").select("file", "value")
    if tasks:
        rows = rows.repartition(tasks)  # a gzip file arrives as one partition
    cells = (rows.select("file", _cells(F.col("value"), separator).alias("c"))
             .select("file", F.element_at("c", 1).alias("row_id"), F.posexplode("c").alias("pos", "text")).where("pos > 0"))
    number = nan_to_null(F.expr("try_cast(text AS double)"))
    return cells.join(broadcast_if_bounded(names), ["file", "pos"]).select(
        F.lit(cohort).alias("cohort"), "row_id", "column_id", (F.col("pos") - 1).alias("column_pos"), number.alias("value"))


def read_matrix_csv(spark: SparkSession, path: str, cohort: str, separator: str = ",",
                    tasks: int | None = None) -> DataFrame:
    """(cohort, barcode, feature, value, feature_pos) of samples x features files, first column the sample.

    Cells that are empty or not a number are null; feature_pos counts the columns of a file from 0.
    """
    cells = _wide_cells(spark, path, cohort, separator, tasks)
    return cells.select("cohort", F.col("row_id").alias("barcode"), F.col("column_id").alias("feature"), "value",
                        F.col("column_pos").alias("feature_pos"))


def read_transposed_tsv(spark: SparkSession, path: str, cohort: str, separator: str = "\t",
                        tasks: int | None = None) -> DataFrame:
    """The same from a features x samples file (gzip or not): in long form nothing is transposed."""
    cells = _wide_cells(spark, path, cohort, separator, tasks)
    return cells.select("cohort", F.col("column_id").alias("barcode"), F.col("row_id").alias("feature"), "value")


def read_labels(spark: SparkSession, path: str, cohort: str, id_col: str = "pan.samplesID",
                label_col: str = "Subtype_Selected", separator: str = ",") -> DataFrame:
    """(cohort, barcode, label, file_pos) of a label file; blanks around its headings are ignored."""
    raw = _existing(lambda: spark.read.option("header", True).option("sep", separator).csv(path), path)
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_row"))
    named = placed.toDF(*[c.strip() for c in raw.columns], "_file", "_block", "_row")
    missing = [c for c in (id_col, label_col) if c not in named.columns]
    if missing:
        raise ValueError(f"missing required columns in label file {path}: {missing}")
    return named.select(F.lit(cohort).alias("cohort"), F.col(f"`{id_col}`").alias("barcode"),
                        F.col(f"`{label_col}`").alias("label"),
                        F.struct("_file", "_block", "_row").alias("file_pos"))


def cohort_paths(registry: dict[str, tuple[str, str]], cohort: str) -> tuple[str, str]:
    """(matrix path, label path) of a registered cohort, by its upper-case name."""
    known = cohort.upper()
    if known not in registry:
        raise ValueError(f"unsupported cohort {cohort!r}, choose from {sorted(registry)}")
    return registry[known]


def write_matrix(matrix: DataFrame, folder: str) -> None:
    """Parquet by cohort, with the cells of a feature together: statistics aggregate before they
    shuffle, and a filter on features skips row groups. A feature with very many cells spreads over several files."""
    (matrix.repartitionByRange("cohort", "feature", "sample_id").sortWithinPartitions("cohort", "feature")
     .write.mode("overwrite").partitionBy("cohort").parquet(folder))


def cached_matrix(spark: SparkSession, folder: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The stored matrix, built and written first when it is absent or `rebuild` is set."""
    if not rebuild:
        try:
            return spark.read.parquet(folder)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    write_matrix(build(), folder)
    return spark.read.parquet(folder)
