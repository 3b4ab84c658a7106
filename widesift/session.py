"""Session defaults and the two run-time facts the operators ask the session for.

The library never needs a session of its own making: every operator takes DataFrames. `build_session`
only collects the settings the jobs were written for, for use in tests, the benchmark and scripts.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BROADCAST_BYTES = 256 * 1024 * 1024
PLAIN_COLUMN_BYTES = 48


def build_session(app: str = "widesift", master: str | None = None, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # row_number() <= k is cut to k rows per map task before the shuffle up to this k
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        # drop checkpoint files once nothing refers to them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        # skips the Python call-site lookup on every column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _row_bytes(schema: T.StructType) -> Column:
    """Approximate in-memory size of a row; text and lists are measured, not assumed."""

    def fixed(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return 16 + sum(fixed(f.dataType) for f in kind.fields)
        return 40 if isinstance(kind, T.StringType) else 8

    def size(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.length(field.name), F.lit(0)) + 16
        if isinstance(field.dataType, T.ArrayType):
            return F.coalesce(F.size(field.name), F.lit(0)) * fixed(field.dataType.elementType) + 32
        return F.lit(fixed(field.dataType))

    return reduce(lambda x, y: x + y, [size(f) for f in schema.fields]).cast("long")


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("widesift.broadcastBytes", str(BROADCAST_BYTES)))


def measured(table: DataFrame) -> tuple[int, int]:
    """Number of rows and approximate bytes, in one job over a table that should have been written already."""
    found = table.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(table.schema)).alias("size")).first()
    return found["n"], found["size"] or 0


def broadcast_if_bounded(side: DataFrame, rows_from: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only for a side measured to be small; a larger one takes the shuffle join.

    The bound is `widesift.broadcastBytes` (256 MiB). Without `rows_from` the side may be the result of a
    long plan: it is written once, measured and joined from there, so that measuring does not run the
    plan a second time. `rows_from` is a cheap DataFrame with at least as many rows, for a side of plain
    columns derived from it (as a split table is from the labels): its row count is the measure.
    Passing the side itself says that it has been written already.
    """
    limit = broadcast_limit(side.sparkSession)
    if rows_from is None:
        side = rows_from = cut_lineage(side)
    if rows_from is side:
        _, total = measured(side)
    else:
        total = rows_from.count() * PLAIN_COLUMN_BYTES * len(side.columns)
    return F.broadcast(side) if total <= limit else side


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan of fewer partitions than cores (one small file) out before costly work per row.

    A large input has more partitions than cores already and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`; on a local master one of its own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
            folder = tempfile.mkdtemp(prefix="widesift-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iterative result in the cluster's checkpoint folder (survives executor loss)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """Writes an iterative result as Parquet and reads it again: unlike a checkpoint's, its plan remembers nothing of earlier rounds."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def finished_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder whose writing came to its end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [status.getPath() for status in files.listStatus(path)]
    return sorted(p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate files, wherever it lies; one that is gone already is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
