"""Line deduplication with levelled sorted runs of line hashes.

What is known of lines is kept as runs: tables of (hash, documents, last document), cut into hash buckets and sorted inside
them. A new batch is aggregated by hash once and merge-anti-joined with every run: a hash leaves the batch where a run says
already that the line is frequent and that no document of the batch comes after its last one. What stays becomes a run of its
own on the lowest level. Two runs of one level are merged into a single run of the next level, so that a batch meets a number
of runs that grows with the logarithm of the number of batches. Runs are bucketed tables: merging them and joining them to a
batch shuffles no run.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from widesift.session import broadcast_if_bounded, checkpoint_folder, remove_folder

#: what is stripped at both ends of a line
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["hi", "lo"]
BATCHES = 4


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    # in ASCII text lower() changes A-Z only, and much faster
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def hashes(value: Column) -> tuple[Column, Column]:
    """128 bits of a string as two longs."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


class LineRuns:
    """Runs of (hi, lo, n, last): a line's hash, the number of documents that hold it, the largest id of one.

    `n` and `last` of one hash in several runs add up by sum and maximum, so a document may be part of one batch only. A row that
    changes neither "at least `least` documents" nor the last one is not stored again. An empty batch adds nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, least: int = 3, buckets: int | None = None):
        self.spark, self.folder, self.least = spark, folder, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        #: from the lowest level up, the run that waits for another one
        self.levels: list[str | None] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> str:
        """Writes rows that lie in hash buckets already."""
        name = f"{self.name}_{self.written}"
        self.written += 1
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def news(self, batch: DataFrame) -> DataFrame:
        """The rows of (hi, lo, n, last) that no single run makes superfluous, in hash buckets."""
        batch = batch.repartition(self.buckets, *HASH)
        for name in self.runs():
            run = self.spark.table(name).where(F.col("n") >= self.least).select(*(F.col(c).alias(f"run_{c}") for c in [*HASH, "last"]))
            # a null id comes before all others
            after = F.col("last").isNull() | F.coalesce(F.col("run_last") >= F.col("last"), F.lit(False))
            batch = batch.join(run.hint("merge"), (F.col("hi") == F.col("run_hi")) & (F.col("lo") == F.col("run_lo")) & after, "left_anti")
        return batch

    def add(self, lines: DataFrame, id_col: str = "doc_id") -> None:
        """Adds a batch of (hi, lo, id_col), a row or more for a line of a document, and merges runs of one level."""
        per_document = lines.select(*HASH, id_col).distinct()
        run = self._write(self.news(per_document.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max(id_col).alias("last"))))
        level = 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._merge(self.levels[level], run), None
            level += 1
        self.levels[level:level + 1] = [run]

    def _merge(self, one: str, other: str) -> str:
        """One run in place of two: a merge join of equal buckets, without a shuffle."""
        a, b = self.spark.table(one).alias("a"), self.spark.table(other).hint("merge").alias("b")
        both = a.join(b, (F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo")), "full_outer")
        n = F.coalesce(F.col("a.n"), F.lit(0)) + F.coalesce(F.col("b.n"), F.lit(0))
        merged = self._write(both.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in HASH), n.alias("n"),
                                         F.greatest("a.last", "b.last").alias("last")))
        self._drop(one)
        self._drop(other)
        return merged

    def frequent(self) -> DataFrame:
        """(hi, lo, last) of lines in at least `least` documents; merges all runs."""
        run, *rest = self.runs()
        self.levels = [None] * len(self.levels)
        for other in rest:
            run = self._merge(run, other)
        self.levels[-1] = run
        return self.spark.table(run).where(F.col("n") >= self.least).select(*HASH, "last")

    def close(self) -> None:
        """Removes the runs."""
        for name in self.runs():
            self._drop(name)
        self.levels = []


def drop_frequent_lines(docs: DataFrame, least_length: int = 20, least_docs: int = 3, batches: int = BATCHES, text_col: str = "text",
                        key_col: str = "doc_id") -> DataFrame:
    """(key_col, n_lines, n_dropped, kept) for every row; `kept` is the text without the lines it loses.

    A line is what stands between \\n; its key is `line_key`. A key of `least_length` code points or more that at least `least_docs`
    documents hold loses all its lines except in the document with the largest id. Null and empty texts are one empty line.
    Rows with one id are one document, as are the rows without an id, which come before all others; each row keeps its own text.
    Other columns are ignored, whatever their names; an empty table gives an empty one. Batches are ranges of falling ids, so that
    the last holder of a line is met first and later batches add little. Only hashes and places of lines are shuffled; a text
    as a whole is held by one task, with its lines.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = _cuts(rows, batches)
    batch = F.lit(0) if not cuts else reduce(lambda x, y: x + y, [F.coalesce(F.col("id") < F.lit(c), F.lit(True)).cast("int") for c in cuts])
    t_hi, t_lo = hashes(F.col("text"))
    lines = rows.select("id", t_hi.alias("t_hi"), t_lo.alias("t_lo"), batch.alias("batch"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_length)
    hi, lo = hashes(F.col("key"))
    keys.select("id", "t_hi", "t_lo", "at", hi.alias("hi"), lo.alias("lo"), "batch").write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(f"id {docs.schema[key_col].dataType.simpleString()}, t_hi bigint, t_lo bigint, at int, hi bigint, lo bigint, batch int").parquet(f"{folder}/lines")
    known = LineRuns(spark, folder, least_docs)
    for i in range(len(cuts) + 1):
        known.add(lines.where(F.col("batch") == i), "id")
    # written, so that a line of very many documents can be split in the join, and that the runs can go
    found = broadcast_if_bounded(known.frequent())
    lost = lines.join(found, HASH).where(~F.col("id").eqNullSafe(F.col("last")))
    places = broadcast_if_bounded(lost.groupBy("id", "t_hi", "t_lo").agg(F.collect_set("at").alias("places")))
    known.close()
    remove_folder(spark, folder)
    places = places.select(F.col("id").alias("lost_id"), F.col("t_hi").alias("lost_hi"), F.col("t_lo").alias("lost_lo"), "places")
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("lost_hi") == t_hi) & (F.col("lost_lo") == t_lo), "left")
    cut = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), "places")
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("cut"), i)), "\n")
    return joined.withColumn("cut", cut).select(
        F.col("id").alias(key_col), F.size("cut").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def _cuts(rows: DataFrame, batches: int) -> list:
    """Ids that cut the rows into ranges of about equal size, falling; where ids are no numbers, there is one range."""
    if batches < 2 or rows.schema["id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return []
    places = rows.agg(F.percentile_approx("id", [1 - i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(places or []), reverse=True)
