"""Matrices, labels and run tables derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from widesift.operators import metrics, moments, reports, scores, selection, splits
from widesift.session import broadcast_if_bounded, cut_lineage, spread

SEEDS = [42, 43, 44, 45, 46]
#: digits of a user in a barcode, and length of the part that names the user
ID_DIGITS = 12
ID_LENGTH = len("USER-") + ID_DIGITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- dense matrix: one sample per embedding, one feature per position -------------------------

def emb_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("C"), (F.col("vec_id") % 3).cast("string")).alias("cohort"),
        F.col("vec_id").cast("string").alias("sample_id"),
        F.col("label").cast("string").alias("label"), "embedding")


def emb_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_vectors(spark, sf_dir).drop("embedding")


def emb_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (emb_vectors(spark, sf_dir)
            .select("cohort", "sample_id", F.posexplode("embedding").alias("pos", "v"))
            .select("cohort", "sample_id",
                    F.concat(F.lit("f"), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("feature"),
                    F.col("v").cast("double").alias("value")))


# ---- sparse matrix: one sample per labelled document, one feature per token -------------------

def doc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(
        F.lit("docs").alias("cohort"), F.col("doc_id").cast("string").alias("sample_id"),
        F.concat("lang", F.col("quality").cast("string")).alias("label"))


def doc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return (docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
            .select("doc_id", words.alias("feature"))
            .groupBy("doc_id", "feature").agg(F.count("*").alias("n"))
            .select(F.lit("docs").alias("cohort"), F.col("doc_id").cast("string").alias("sample_id"),
                    "feature", F.log1p(F.col("n").cast("double")).alias("value")))


# ---- readings with repeated sample barcodes ---------------------------------------------------

def evt_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.lit("E").alias("cohort"),
        F.concat(F.lit("USER-"), F.lpad(F.col("user_id").cast("string"), ID_DIGITS, "0"), F.lit("-"),
                 F.col("event_id").cast("string")).alias("barcode"),
        F.col("event_id").alias("file_pos"), F.col("event_type").alias("feature"), "value")


def evt_hour_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.lit("E").alias("cohort"),
        F.concat(F.lit("USER-"), F.lpad(F.col("user_id").cast("string"), ID_DIGITS, "0"), F.lit("-"),
                 F.col("event_id").cast("string")).alias("barcode"),
        F.concat("event_type", F.lit("_"), F.lpad(F.hour("ts").cast("string"), 2, "0")).alias("feature"), "value")


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several label rows per patient, in file order, some incomplete: one per order of a customer."""
    return table(spark, sf_dir, "orders").select(
        F.lit("E").alias("cohort"),
        F.concat(F.lit("USER-"), F.lpad(F.col("o_custkey").cast("string"), ID_DIGITS, "0"), F.lit("-"),
                 F.col("o_orderkey").cast("string")).alias("barcode"),
        F.col("o_orderkey").alias("file_pos"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("label"))


# ---- a deterministic predictor, so that evaluation can be compared row by row -----------------

FEATURE_SETS = {"anova": ["k=10", "k=20"], "baseline": ["all"],
                "variance": ["tau=0.015", "tau=0.016", "tau=0.017"]}


def feature_sets(feature_moments: DataFrame) -> DataFrame:
    """(cohort, seed, method, param, feature) for every method and param of FEATURE_SETS."""
    everything = scores.variance_scores(feature_moments)
    anova = selection.ranked_scores(scores.anova_scores(feature_moments))
    picked = [everything.select("cohort", "seed", "feature", F.array(F.struct(
        F.lit("baseline").alias("method"), F.lit("all").alias("param"))).alias("sets")),
        anova.select("cohort", "seed", "feature", F.array(*[
            F.when(F.col("rank") <= int(p[2:]), F.struct(F.lit("anova").alias("method"), F.lit(p).alias("param")))
            for p in FEATURE_SETS["anova"]]).alias("sets")),
        everything.select("cohort", "seed", "feature", F.array(*[
            F.when(F.col("score") > float(p[4:]), F.struct(F.lit("variance").alias("method"), F.lit(p).alias("param")))
            for p in FEATURE_SETS["variance"]]).alias("sets"))]
    union = picked[0].unionByName(picked[1]).unionByName(picked[2])
    return (union.select("cohort", "seed", "feature", F.explode(F.array_compact("sets")).alias("s"))
            .select("cohort", "seed", "s.method", "s.param", "feature"))


def centroid_scores(matrix: DataFrame, split: DataFrame, stats: DataFrame,
                    sets: DataFrame | None = None) -> DataFrame:
    """Minus the squared distance of every test sample to every class mean, over each feature set."""
    test = split.where(F.col("part") == "test").select("cohort", "seed", "sample_id", "label")
    means = stats.groupBy("cohort", "seed", "feature").agg(
        F.collect_list(F.struct(F.col("label").alias("class"), "mean")).alias("means"))
    if sets is None:
        means = means.withColumn("method", F.lit("baseline")).withColumn("param", F.lit("all"))
    else:
        means = means.join(sets, ["cohort", "seed", "feature"])
    cells = (matrix.join(broadcast_if_bounded(test, rows_from=split), ["cohort", "sample_id"])
             .join(broadcast_if_bounded(means), ["cohort", "seed", "feature"]))
    gap = F.col("value") - F.col("m.mean")
    return (cells.select("cohort", "seed", "method", "param", "sample_id", "label", "value",
                         F.explode("means").alias("m"))
            .groupBy("cohort", "seed", "method", "param", "sample_id", "label", F.col("m.class").alias("class"))
            .agg((-F.round(F.sum(gap * gap), 9)).alias("score")))


def centroid_predictions(distances: DataFrame) -> DataFrame:
    """Predictions with probabilities in steps of 1e-9, so that both engines see the same ties."""
    found = metrics.predictions_from_scores(distances, metrics.RUN_KEYS)
    return found.withColumn("proba", F.transform_values("proba", lambda _, p: F.round(p, 9)))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature set of FEATURE_SETS evaluated for every cohort and seed.

    The tables that several later steps read (split, statistics, feature sets, predictions) are written
    once, as a benchmark run writes them, instead of being derived again by each reader.
    """
    samples, matrix = emb_samples(spark, sf_dir), emb_matrix(spark, sf_dir)
    split = cut_lineage(splits.stratified_split(samples, SEEDS))
    stats = cut_lineage(moments.feature_stats(matrix, split, SEEDS, samples))
    summary = moments.feature_moments(stats)
    sets = cut_lineage(feature_sets(summary))
    distances = centroid_scores(matrix, split, stats, sets)
    predictions = cut_lineage(centroid_predictions(distances))
    width = stats.groupBy("cohort").agg(F.count_distinct("feature").alias("n_features_total"))
    grid = splits.job_grid(samples, SEEDS, FEATURE_SETS)
    records = reports.run_records(grid, sets, metrics.evaluate(predictions), width)
    # stand-in times: functions of the feature count, so that both engines have the same ones
    count = F.when(F.col("n_features") > 0, F.col("n_features"))
    return records.withColumns({"train_time_s": count * 0.25, "run_time_s": count * 0.5})
