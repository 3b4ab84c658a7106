"""The registered queries of the subpackage: name -> function(spark, sf_dir) -> DataFrame, with a SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from widesift.llm import (blob_ledger, contamination, language, line_runs, packing, personal, quotations, simhash, spelling, token_counts,
                          twins, url_lists, vectors, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function
    return register


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query(twins.VECTORS)
def op3_vectors(spark, sf_dir):
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose messages quote: a hash of conversation and turn decides whether the message before is quoted, and the one before that at a second level.

    The given messages quote nothing; every message is kept, with its own text whole behind the quotations.
    """
    messages = table(spark, sf_dir, "conversations")
    said = lambda back: messages.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(f"said{back}"))
    near = messages.join(said(1), ["conv_id", "turn"], "left").join(said(2), ["conv_id", "turn"], "left")
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 1)) - 1
    quoted = lambda name, marks: F.concat(F.lit(marks), F.replace(F.col(name), F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))
    second = F.when((digit >= 4) & (digit < 8), quoted("said2", ">> "))
    first = F.when(digit < 10, quoted("said1", "> "))
    return near.select("conv_id", "turn", "role",
                       F.concat(F.coalesce(second, F.lit("")), F.coalesce(first, F.lit("")), F.col("text")).alias("text"))


@query(twins.QUOTATIONS)
def op4_quotations(spark, sf_dir):
    found = quotations.link(replies(spark, sf_dir))
    return found.select("conv_id", "turn", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", "n_quotes", "n_linked", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"),
                        F.sha2(quotations.formatted(F.col("role"), F.col("own")), 256).alias("message_sha256"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a day of fetching, which the page's number decides."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))


def dated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions to and removals from three lists, derived from the hosts of `pages`: a hash of the host decides lists and days."""
    hosts = table(spark, sf_dir, "pages").select(url_lists.host_of(F.col("url")).alias("host")).dropna().distinct()
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("host"), at, 1)) - 1
    hosts = hosts.withColumns({"x": digit(1), "y": digit(2)})
    event = lambda name, kind, value, action, start, days: F.struct(
        F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"),
        F.date_add(F.lit(start).cast("date"), days.cast("int")).alias("dated"))
    host, x, y = F.col("host"), F.col("x"), F.col("y")
    some = lambda when, *events: F.when(when, F.array(*events)).otherwise(F.array())
    return hosts.select(F.explode(F.concat(
        some(x < 6, event("malware", "host", host, "add", "2023-12-01", y * 20), event("malware", "host", host, "remove", "2023-12-01", y * 20 + 90),
             event("malware", "host", host, "add", "2023-12-01", y * 20 + 150)),
        some((x >= 13) & (F.size(F.split("host", r"\.")) >= 4), event("adult", "domain", F.regexp_replace("host", r"^[^.]+\.", ""), "add", "2024-02-01", y * 10)),
        some(x % 2 == 0, event("spam", "prefix", F.concat(host, F.lit("/en")), "add", "2024-01-01", y * 5),
             event("spam", "prefix", F.concat(host, F.lit("/en")), "remove", "2024-01-01", y * 5 + 120)))).alias("e")).select("e.*")


@query(twins.URL_LISTS)
def op5_url_lists(spark, sf_dir):
    found = url_lists.active(captures(spark, sf_dir), dated_lists(spark, sf_dir))
    return found.select("page_id", url_lists.host_of(F.col("url")).alias("host"), F.col("fetched_at").cast("string").alias("fetched_on"),
                        F.array_join("lists", ",").alias("lists"), (F.size("lists") > 0).alias("blocked"))


@query(twins.SECRETS)
def op6_secrets(spark, sf_dir):
    found, _ = blob_ledger.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(value.alias(name) for name, value in blob_ledger.digest(F.col("spans")).items()))


@query()
def op7_personal(spark, sf_dir):
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(value.alias(name) for name, value in personal.digest(F.col("base"), F.col("found")).items()))


def language_model(rows: DataFrame) -> language.Model:
    return language.fit(rows.where(~language.held_out(F.col("doc_id"))), language.vocabulary(vocabulary("piece_bpe_32k.model")))


@query()
def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language_model(docs)).withColumn("held_out", language.held_out(F.col("doc_id")))


@query(twins.CONTAMINATION)
def op9_contamination(spark, sf_dir):
    found = contamination.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)
    return found.select("doc_id", "n_words", contamination.coverage(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        contamination.contaminated(F.col("n_words"), F.col("hits")).alias("contaminated"))


@query()
def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query(twins.LINES)
def op11_lines(spark, sf_dir):
    found = line_runs.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(twins.SPELLING)
def op12_spelling(spark, sf_dir):
    return spelling.group_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query()
def op13_whitening(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))
