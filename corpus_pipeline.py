"""A corpus pipeline over `documents`: every stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from widesift.llm import blob_ledger, catalog, contamination, language, packing, simhash
from widesift.session import checkpoint_folder, cut_lineage

#: below this posterior a document's language counts as unknown
LEAST_SCORE = 0.5


def whole(docs: DataFrame) -> DataFrame:
    """(row, text): the whole row as a key of its own, so that a verdict is passed on the row and on no other one."""
    return docs.select(F.struct("*").alias("row"), "text")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: without letters, or with no language more likely than not."""
    found = language.identify(whole(docs), catalog.language_model(docs), key_col="row")
    return found.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates: that with the smallest id, a row without an id only where none has one.

    Rows are numbered and written once, and the numbers are compared; rows of one id with different texts are different documents.
    """
    folder = f"{checkpoint_folder(spark)}/rows-{uuid.uuid4().hex}"
    docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    found = simhash.near_duplicates(rows.select("number", "row.text"), id_col="number").select(F.col("id").alias("number"), "component")
    ranked = found.join(rows.select("number", "row.doc_id"), "number").withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "number"))
    named = cut_lineage(ranked.select("number", "component", "rank"))
    # written, so that a group of very many rows can be split in the join
    first = cut_lineage(named.groupBy("component").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = cut_lineage(named.join(first.select("component", F.col("rank.number").alias("kept")), "component").where("number != kept").select("number"))
    return rows.join(again, "number", "left_anti").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least one in twenty stands in a passage of the benchmark."""
    found = contamination.match(whole(docs), catalog.table(spark, sf_dir, "benchmark"), key_col="row", nameless=True)
    return found.where(~contamination.contaminated(F.col("n_words"), F.col("hits"))).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and brings n_chars up to date where that changes a text; everything else stays."""
    found, _ = blob_ledger.find_secrets(docs.select(F.struct("*").alias("row"), "text"))
    clean = blob_ledger.redacted(found)
    text, n_chars = F.col("row.text"), F.col("row.n_chars")
    changed = clean.withColumn("n_chars", F.when(F.col("text") == text, n_chars).otherwise(F.length("text").cast("bigint")))
    replaced = {"text": F.col("text"), "n_chars": F.when(text.isNull(), n_chars).otherwise(F.col("n_chars"))}
    return changed.select(*(replaced.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece of a document."""
    return packing.pack(docs, catalog.vocabulary("byte_bpe_50k.json"))


STAGES = [("language ID", known_language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminated),
          ("secret scans", without_secrets), ("packing", packed)]
#: tokenizers, trained models and XXH64 have no SQL; the tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each stage's rows are written as Parquet and read again by the next one."""
    docs = catalog.table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
