"""The registered queries: name -> function(spark, sf_dir) -> DataFrame, each with its SQL twin if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import fixtures as fx
from checks.oracles import RUN, on, r6, sql
from widesift.functions.columns import rounded, significant
from widesift.operators import align, embedded, forward, information, metrics, models, moments, prepare, reports, scores, selection, splits, stochastic
from widesift.plans import benchmark
from widesift.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function
    return register


def emb_split(spark, sf_dir):
    return splits.stratified_split(fx.emb_samples(spark, sf_dir), fx.SEEDS)


def emb_stats(spark, sf_dir):
    samples = fx.emb_samples(spark, sf_dir)
    return moments.feature_stats(fx.emb_matrix(spark, sf_dir), splits.stratified_split(samples, fx.SEEDS),
                                 fx.SEEDS, samples)


def emb_moments(spark, sf_dir):
    return moments.feature_moments(emb_stats(spark, sf_dir))


@query(sql("SELECT cohort, seed, sample_id, label, part FROM emb_split", "emb_split"))
def stratified_split(spark, sf_dir):
    return emb_split(spark, sf_dir)


@query(sql(f"SELECT cohort, seed, feature, label, n, {r6('mean')} AS mean, {r6('m2')} AS m2 FROM emb_stats", "emb_stats"))
def feature_stats(spark, sf_dir):
    return emb_stats(spark, sf_dir).select("cohort", "seed", "feature", "label", "n", rounded("mean").alias("mean"),
                                           rounded("m2").alias("m2"))


@query(sql(f"SELECT cohort, seed, feature, {r6('score')} AS score FROM emb_f", "emb_f"))
def anova_f(spark, sf_dir):
    return scores.anova_scores(emb_moments(spark, sf_dir)).select("cohort", "seed", "feature", rounded("score").alias("score"))


@query(sql(f"""SELECT cohort, seed, feature, {r6('score')} AS score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort, seed ORDER BY sig(score) DESC, feature DESC) AS rn FROM emb_f)
  WHERE rn <= 20""", "emb_f"))
def anova_top_k(spark, sf_dir):
    best = selection.top_k(scores.anova_scores(emb_moments(spark, sf_dir)), 20)
    return best.select("cohort", "seed", "feature", rounded("score").alias("score"), "rank")


def six(df: DataFrame, *columns: str) -> DataFrame:
    """The named double columns rounded to six digits."""
    return df.withColumns({c: rounded(c) for c in columns})


def r6s(*columns: str) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in columns)


# ---- label preparation and alignment ----------------------------------------------------------

@query(sql(f"""SELECT c.cohort, c.sample_id, c.feature, {r6('c.value')} AS value, l.label
  FROM evt_cells c JOIN ord_lab l ON {on('c', 'l', 'cohort, sample_id')}""", "evt_cells", "ord_lab"))
def align_average_dedup(spark, sf_dir):
    labels = align.prepare_labels(fx.order_labels(spark, sf_dir), "barcode", "label", "file_pos", fx.ID_LENGTH)
    return six(align.align(align.average_duplicates(fx.evt_readings(spark, sf_dir), id_length=fx.ID_LENGTH), labels), "value")


@query(sql(f"""SELECT r.cohort, substr(r.barcode, 1, 17) AS sample_id, r.feature, r.value, l.label
  FROM evt_read r JOIN (SELECT 'E' AS cohort, 'USER-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS sample_id, c_mktsegment AS label
    FROM customer WHERE c_mktsegment IS NOT NULL) l ON r.cohort = l.cohort AND substr(r.barcode, 1, 17) = l.sample_id""", "evt_read"))
def align_merge_no_dedup(spark, sf_dir):
    from widesift.functions.columns import patient_id
    clinical = fx.table(spark, sf_dir, "customer").select(
        F.lit("E").alias("cohort"), F.concat(F.lit("USER-"), F.lpad(F.col("c_custkey").cast("string"), fx.ID_DIGITS, "0")).alias("id"),
        "c_mktsegment")
    labels = align.complete_labels(clinical, "id", "c_mktsegment", id_length=fx.ID_LENGTH)
    readings = fx.evt_readings(spark, sf_dir).select("cohort", patient_id("barcode", fx.ID_LENGTH).alias("sample_id"), "feature", "value")
    return align.align(readings, labels)


@query(sql("""SELECT cohort, sample_id, label FROM doc_lab
  WHERE (cohort, label) IN (SELECT cohort, label FROM doc_lab GROUP BY 1, 2 HAVING count(*) >= 40)""", "doc_lab"))
def rare_class_filter(spark, sf_dir):
    return align.drop_rare_classes(fx.doc_samples(spark, sf_dir), 40).select("cohort", "sample_id", "label")


@query(sql("SELECT cohort, label, count(*) AS n FROM doc_lab WHERE label <> 'en1' GROUP BY 1, 2", "doc_lab"))
def named_class_filter(spark, sf_dir):
    return align.class_distribution(align.drop_class(fx.doc_samples(spark, sf_dir), "en1"))


@query(sql("SELECT cohort, label, count(*) AS n FROM evt_common GROUP BY 1, 2", "evt_common"))
def class_distribution(spark, sf_dir):
    labels = align.prepare_labels(fx.order_labels(spark, sf_dir), "barcode", "label", "file_pos", fx.ID_LENGTH)
    matrix = align.average_duplicates(fx.evt_readings(spark, sf_dir), id_length=fx.ID_LENGTH)
    return align.class_distribution(align.common_samples(matrix, labels))


@query(sql("""SELECT c.cohort, count(DISTINCT c.sample_id) AS n_samples, count(DISTINCT c.feature) AS n_features,
  (SELECT count(*) FROM ord_lab) AS n_labelled, (SELECT count(*) FROM evt_common) AS n_common
  FROM evt_cells c GROUP BY 1""", "evt_cells", "ord_lab", "evt_common"))
def matrix_shape(spark, sf_dir):
    labels = align.prepare_labels(fx.order_labels(spark, sf_dir), "barcode", "label", "file_pos", fx.ID_LENGTH)
    return align.matrix_shape(align.average_duplicates(fx.evt_readings(spark, sf_dir), id_length=fx.ID_LENGTH), labels)


@query(sql("""SELECT cohort, sample_id, label, CAST(dense_rank() OVER (PARTITION BY cohort ORDER BY label) - 1 AS INTEGER) AS label_index
  FROM doc_lab""", "doc_lab"))
def label_index(spark, sf_dir):
    return align.label_index(fx.doc_samples(spark, sf_dir)).select("cohort", "sample_id", "label", "label_index")


@query(sql("""SELECT cohort, sample_id, feature, round((CAST(CAST(value AS FLOAT) AS DOUBLE) - value) * 1e6, 3) + 0.0 AS lost_millionths
  FROM evt_cells""", "evt_cells"))
def to_float32(spark, sf_dir):
    cells = align.average_duplicates(fx.evt_readings(spark, sf_dir), id_length=fx.ID_LENGTH).withColumn("exact", F.col("value"))
    lost = (F.col("value").cast("double") - F.col("exact")) * 1e6
    return align.to_float32(cells).select("cohort", "sample_id", "feature", rounded(lost, 3).alias("lost_millionths"))


# ---- splits -----------------------------------------------------------------------------------

@query(sql("""SELECT cohort, seed, sample_id, label, CAST((rn - 1) % 3 AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed, label ORDER BY md5('fold:' || CAST(seed AS VARCHAR) || ':' || sample_id), sample_id) AS rn
  FROM emb_split WHERE part = 'train')""", "emb_split"))
def stratified_folds(spark, sf_dir):
    train = emb_split(spark, sf_dir).where(F.col("part") == "train").drop("part")
    return splits.stratified_folds(train, 3).select("cohort", "seed", "sample_id", "label", "fold")


@query(sql("SELECT cohort, seed, label, part, count(*) AS n FROM emb_split GROUP BY ALL", "emb_split"))
def split_grid(spark, sf_dir):
    return emb_split(spark, sf_dir).groupBy("cohort", "seed", "label", "part").agg(F.count("*").alias("n"))


@query(sql("""SELECT cohort, CAST(seed - 42 AS INTEGER) AS run_id, seed, method, param FROM (SELECT DISTINCT cohort FROM emb_lab),
  (SELECT CAST(unnest(range(42, 52)) AS INTEGER) AS seed), (SELECT unnest(['anova', 'variance', 'variance']) AS method,
    unnest(['k=5000', 'tau=0.05', 'tau=0.10']) AS param)""", "emb_lab"))
def job_grid(spark, sf_dir):
    return splits.job_grid(fx.emb_samples(spark, sf_dir), splits.consecutive_seeds(42, 10),
                           {"anova": ["k=5000"], "variance": ["tau=0.05", "tau=0.10"]})


# ---- variance ---------------------------------------------------------------------------------

TAUS = [0.0145, 0.015, 0.0155, 0.016, 0.0165, 0.017]


@query(sql("""SELECT cohort, seed, CAST(t AS DOUBLE) AS threshold, count(*) AS n_features_total,
  count(*) FILTER (WHERE variance > CAST(t AS DOUBLE)) AS n_features
  FROM emb_mom, (SELECT unnest(['0.0145', '0.015', '0.0155', '0.016', '0.0165', '0.017']) AS t) GROUP BY ALL""", "emb_mom"))
def variance_sweep_counts(spark, sf_dir):
    return scores.variance_sweep(emb_moments(spark, sf_dir), TAUS)


@query(sql(f"SELECT cohort, seed, feature, {r6('variance')} AS score FROM emb_mom WHERE variance > 0.016::DOUBLE", "emb_mom"))
def variance_selected(spark, sf_dir):
    kept = selection.select_features(scores.variance_scores(emb_moments(spark, sf_dir)), "threshold", 0.016)
    return six(kept, "score")


@query(sql(f"""SELECT cohort, seed, feature, {r6('variance')} AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed ORDER BY sig(variance) DESC, feature) AS rn FROM emb_mom) WHERE rn <= 10""", "emb_mom"))
def top_variance(spark, sf_dir):
    best = selection.top_k(scores.variance_scores(emb_moments(spark, sf_dir)), 10, higher_index_wins=False)
    return six(best, "score")


@query(sql(f"""SELECT cohort, seed, feature, {r6('variance')} AS score_e12, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed ORDER BY sig(variance) DESC, feature) AS rn FROM emb_mom) WHERE rn <= 10""", "emb_mom"))
def top_variance_small_units(spark, sf_dir):
    """The ranking of values a million times smaller; a unit decides nothing."""
    samples = fx.emb_samples(spark, sf_dir)
    small = fx.emb_matrix(spark, sf_dir).withColumn("value", F.col("value") * 1e-6)
    stats = moments.feature_stats(small, splits.stratified_split(samples, fx.SEEDS), fx.SEEDS, samples)
    best = selection.top_k(scores.variance_scores(moments.feature_moments(stats)), 10, higher_index_wins=False)
    return best.select("cohort", "seed", "feature", rounded(F.col("score") * 1e12).alias("score_e12"), "rank")


@query(sql("SELECT cohort, seed, feature, sig(score, 4) AS score FROM emb_f", "emb_f"))
def anova_f_shifted(spark, sf_dir):
    """F of values far from zero, on the path that fills gaps (there are none): the shift changes nothing."""
    samples = fx.emb_samples(spark, sf_dir)
    shifted = fx.emb_matrix(spark, sf_dir).withColumn("value", F.col("value") + 1e5)
    split = cut_lineage(splits.stratified_split(samples, fx.SEEDS))
    stats = moments.feature_stats(shifted, split, fx.SEEDS, samples)
    found = scores.anova_scores(moments.feature_moments(stats, moments.class_sizes(split)))
    return found.select("cohort", "seed", "feature", significant("score", 4).alias("score"))


# ---- sparse matrix ----------------------------------------------------------------------------

def doc_moments(spark, sf_dir):
    samples = fx.doc_samples(spark, sf_dir)
    split = cut_lineage(splits.stratified_split(samples, fx.SEEDS))
    stats = moments.feature_stats(fx.doc_matrix(spark, sf_dir), split, fx.SEEDS, samples)
    return moments.feature_moments(stats, moments.class_sizes(split))


DOC_F = """SELECT cohort, seed, feature, n, k, tokens, CASE WHEN k < 2 OR n <= k OR hi = lo THEN NULL WHEN within_ss <= 1e-12::DOUBLE * (between_ss + within_ss) THEN 'inf'::DOUBLE
  ELSE (between_ss / (k - 1)) / (within_ss / (n - k)) END AS score, (between_ss + within_ss) / n AS variance, hi > lo AS varies FROM (
  SELECT s.cohort, s.seed, s.feature, t.n, t.k, sum(s.present) AS tokens, sum(q) - sum(s.s * s.s / c.size) AS within_ss,
    sum(c.size * (s.s / c.size - s.mean) * (s.s / c.size - s.mean)) + (t.n - sum(c.size)) * any_value(s.mean) * any_value(s.mean) AS between_ss,
    CASE WHEN sum(s.present) = t.n THEN min(lo) ELSE least(min(lo), 0) END AS lo, CASE WHEN sum(s.present) = t.n THEN max(hi) ELSE greatest(max(hi), 0) END AS hi
  FROM (SELECT g.*, sum(s) OVER (PARTITION BY g.cohort, g.seed, feature) / z.n AS mean FROM (SELECT p.cohort, p.seed, p.label, x.feature, count(*) AS present, sum(x.value) AS s, sum(x.value * x.value) AS q, min(x.value) AS lo, max(x.value) AS hi
    FROM doc_split p JOIN doc_cells x ON p.cohort = x.cohort AND p.sample_id = x.sample_id WHERE p.part = 'train' GROUP BY ALL) g
    JOIN (SELECT cohort, seed, count(*) AS n FROM doc_split WHERE part = 'train' GROUP BY ALL) z ON z.cohort = g.cohort AND z.seed = g.seed) s
  JOIN (SELECT cohort, seed, label, count(*) AS size FROM doc_split WHERE part = 'train' GROUP BY ALL) c
    ON s.cohort = c.cohort AND s.seed = c.seed AND s.label = c.label
  JOIN (SELECT cohort, seed, count(*) AS n, count(DISTINCT label) AS k FROM doc_split WHERE part = 'train' GROUP BY ALL) t
    ON s.cohort = t.cohort AND s.seed = t.seed GROUP BY s.cohort, s.seed, s.feature, t.n, t.k)"""
from checks.oracles import cte  # noqa: E402

cte("doc_f", DOC_F, "doc_split", "doc_cells")


@query(sql(f"SELECT cohort, seed, feature, {r6('score')} AS score FROM doc_f", "doc_f"))
def anova_f_sparse(spark, sf_dir):
    return six(scores.anova_scores(doc_moments(spark, sf_dir)), "score")


@query(sql(f"""SELECT cohort, seed, feature, {r6('score')} AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed ORDER BY sig(score, 6) DESC NULLS LAST, feature DESC) AS rn FROM doc_f) WHERE rn <= 2000""", "doc_f"))
def anova_top_k_sparse(spark, sf_dir):
    best = selection.top_k(scores.anova_scores(doc_moments(spark, sf_dir)), 2000, buckets=16, digits=6)
    return six(best, "score")


@query(sql("""SELECT cohort, seed, CAST(t AS DOUBLE) AS threshold, count(*) AS n_features_total,
  count(*) FILTER (WHERE variance > CAST(t AS DOUBLE)) AS n_features
  FROM doc_f, (SELECT unnest(['0.05', '0.10', '0.25', '0.50', '0.75']) AS t) GROUP BY ALL""", "doc_f"))
def variance_sweep_sparse(spark, sf_dir):
    return scores.variance_sweep(doc_moments(spark, sf_dir), [0.05, 0.10, 0.25, 0.50, 0.75])


@query(sql("""SELECT f.cohort, f.seed, (SELECT count(DISTINCT feature) FROM doc_cells) AS n_features_total,
  count(*) FILTER (WHERE varies) AS n_varying FROM doc_f f GROUP BY 1, 2""", "doc_f", "doc_cells"))
def constant_features(spark, sf_dir):
    # a token that no training document holds is constant too: it has no row in the moments
    total = fx.doc_matrix(spark, sf_dir).groupBy("cohort").agg(F.count_distinct("feature").alias("n_features_total"))
    kept = scores.varying_features(doc_moments(spark, sf_dir)).groupBy("cohort", "seed").agg(F.count("*").alias("n_varying"))
    return kept.join(total, "cohort").select("cohort", "seed", "n_features_total", "n_varying")


# ---- masks over a score table -----------------------------------------------------------------

@query(sql(f"""SELECT cohort, seed, feature, {r6('score')} AS score FROM (SELECT *, avg(score) OVER (PARTITION BY cohort, seed) AS m FROM emb_f)
  WHERE score > m""", "emb_f"))
def select_gt_mean(spark, sf_dir):
    return six(selection.select_features(scores.anova_scores(emb_moments(spark, sf_dir)), "gt_mean"), "score")


@query(sql("SELECT cohort, seed, feature, floor(score) AS score FROM emb_f WHERE floor(score) <> 0", "emb_f"))
def select_nonzero(spark, sf_dir):
    whole = scores.anova_scores(emb_moments(spark, sf_dir)).withColumn("score", F.floor("score").cast("double"))
    return selection.select_features(whole, "nonzero")


@query(sql("""SELECT cohort, seed, string_agg(feature, ';' ORDER BY rn) AS features, count(*) AS n_features
  FROM emb_anova_rank WHERE rn <= 20 GROUP BY 1, 2""", "emb_anova_rank"))
def feature_list_string(spark, sf_dir):
    best = selection.top_k(scores.anova_scores(emb_moments(spark, sf_dir)), 20)
    return selection.feature_list(best, ["cohort", "seed"])


@query(sql(f"""SELECT cohort, seed, feature, {r6('score')} AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed ORDER BY sig(score) DESC, feature) AS rn FROM emb_f) WHERE rn <= 50""", "emb_f"))
def top_n_features(spark, sf_dir):
    return six(selection.top_k(scores.anova_scores(emb_moments(spark, sf_dir)), 50, higher_index_wins=False), "score")


# ---- imputation, fractions, scaling, projection -----------------------------------------------

def hour_inputs(spark, sf_dir):
    labels = align.prepare_labels(fx.order_labels(spark, sf_dir), "barcode", "label", "file_pos", fx.ID_LENGTH)
    matrix = cut_lineage(align.average_duplicates(fx.evt_hour_readings(spark, sf_dir), id_length=fx.ID_LENGTH))
    samples = align.common_samples(matrix, labels)
    return matrix, labels, samples, cut_lineage(splits.stratified_split(samples, fx.SEEDS))


cte("hour_train", f"""SELECT s.cohort, s.seed, s.sample_id, s.label, c.feature, c.value FROM hour_split s
  JOIN hour_cells c ON {on('s', 'c', 'cohort, sample_id')} WHERE s.part = 'train'""", "hour_split", "hour_cells")
cte("hour_median", "SELECT cohort, seed, feature, quantile_cont(value, 0.5) AS fill FROM hour_train GROUP BY ALL", "hour_train")
cte("hour_dense", f"""SELECT s.cohort, s.seed, s.sample_id, s.label, s.part, m.feature, coalesce(c.value, m.fill) AS value, c.value IS NULL AS imputed
  FROM hour_split s JOIN hour_median m ON {on('s', 'm', 'cohort, seed')}
  LEFT JOIN hour_cells c ON {on('c', 's', 'cohort, sample_id')} AND c.feature = m.feature""", "hour_split", "hour_median", "hour_cells")
cte("hour_f", f"""SELECT cohort, seed, feature, CASE WHEN k < 2 OR n <= k OR hi = lo THEN NULL
    WHEN within_ss <= 1e-12::DOUBLE * (between_ss + within_ss) THEN 'inf'::DOUBLE ELSE (between_ss / (k - 1)) / (within_ss / (n - k)) END AS score FROM (
  SELECT s.cohort, s.seed, s.feature, sum(s.n * (s.mean - g.mean) * (s.mean - g.mean)) AS between_ss, sum(s.m2) AS within_ss,
    sum(s.n) AS n, count(*) AS k, any_value(g.lo) AS lo, any_value(g.hi) AS hi
  FROM (SELECT cohort, seed, feature, label, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS m2 FROM hour_dense WHERE part = 'train' GROUP BY ALL) s
  JOIN (SELECT cohort, seed, feature, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM hour_dense WHERE part = 'train' GROUP BY ALL) g
    ON {on('s', 'g', 'cohort, seed, feature')} GROUP BY ALL)""", "hour_dense")


@query(sql(f"SELECT cohort, seed, feature, {r6('fill')} AS fill FROM hour_median", "hour_median"))
def train_medians(spark, sf_dir):
    matrix, _, _, split = hour_inputs(spark, sf_dir)
    return six(prepare.train_medians(matrix, split), "fill")


@query(sql(f"SELECT cohort, seed, sample_id, part, feature, {r6('value')} AS value, imputed FROM hour_dense", "hour_dense"))
def median_impute(spark, sf_dir):
    matrix, _, _, split = hour_inputs(spark, sf_dir)
    return six(prepare.median_impute(matrix, split, prepare.train_medians(matrix, split)), "value")


@query(sql(f"""SELECT cohort, seed, fraction, feature, {r6('score')} AS score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT f.*, t.fraction, row_number() OVER (PARTITION BY cohort, seed, fraction ORDER BY sig(score) DESC NULLS LAST, feature DESC) AS rn,
    count(*) OVER (PARTITION BY cohort, seed, fraction) AS width
  FROM hour_f f, (SELECT unnest([0.01::DOUBLE, 0.05, 0.10, 0.25, 0.50]) AS fraction) t)
  WHERE rn <= greatest(1, floor(width * fraction))""", "hour_f"))
def kbest_fraction(spark, sf_dir):
    matrix, labels, _, split = hour_inputs(spark, sf_dir)
    stats = moments.feature_stats(matrix, split, fx.SEEDS, labels)
    filled = moments.feature_moments(stats, moments.class_sizes(split), prepare.train_medians(matrix, split))
    best = selection.top_fraction(scores.anova_scores(filled), [0.01, 0.05, 0.10, 0.25, 0.50])
    return six(best.select("cohort", "seed", "fraction", "feature", "score", "rank"), "score")


@query(sql(f"""SELECT c.cohort, m.seed, c.sample_id, c.feature, {r6('(c.value - m.mean) / CASE WHEN m.variance = 0 THEN 1 ELSE sqrt(m.variance) END')} AS scaled
  FROM emb_cells c JOIN emb_mom m ON {on('c', 'm', 'cohort, feature')}""", "emb_cells", "emb_mom"))
def standard_scale(spark, sf_dir):
    scaled = prepare.standard_scale(fx.emb_matrix(spark, sf_dir), emb_moments(spark, sf_dir))
    return six(scaled.select("cohort", "seed", "sample_id", "feature", "scaled"), "scaled")


@query(sql(f"""SELECT c.cohort, a.seed, c.sample_id, c.feature, {r6('c.value')} AS value FROM emb_cells c
  JOIN emb_anova_rank a ON {on('c', 'a', 'cohort, feature')} WHERE a.rn <= 20""", "emb_cells", "emb_anova_rank"))
def project_features(spark, sf_dir):
    best = selection.top_k(scores.anova_scores(emb_moments(spark, sf_dir)), 20).select("cohort", "seed", "feature")
    projected = selection.project_features(fx.emb_matrix(spark, sf_dir), best)
    return six(projected.select("cohort", "seed", "sample_id", "feature", "value"), "value")


def vector_facts(rows):
    """width, number of stored values and position-weighted sum of the vectors, read from their sparse form."""
    plain = "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    parts = rows.withColumn("v", F.from_json(F.to_json(F.struct("features")), plain)["features"])
    places = F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1))
    weighted = F.aggregate(F.zip_with(places, "v.values", lambda i, x: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.columns[:-1], parts.withColumns({
        "width": F.coalesce("v.size", F.size("v.values")).cast("bigint"), "stored": F.size("v.values").cast("bigint"), "weighted": rounded(weighted, 5)})


@query(sql("""SELECT c.cohort, c.sample_id, any_value(w.width) AS width, count(*) AS stored, round(sum(c.value * p.pos), 5) AS weighted
  FROM doc_cells c JOIN (SELECT cohort, feature, row_number() OVER (PARTITION BY cohort ORDER BY feature) AS pos FROM (SELECT DISTINCT cohort, feature FROM doc_cells)) p
    ON p.cohort = c.cohort AND p.feature = c.feature JOIN (SELECT cohort, count(DISTINCT feature) AS width FROM doc_cells GROUP BY 1) w ON w.cohort = c.cohort
  GROUP BY 1, 2""", "doc_cells"))
def assemble_sparse(spark, sf_dir):
    cells = cut_lineage(fx.doc_matrix(spark, sf_dir))
    rows = prepare.assemble(cells, ["cohort", "sample_id"], "value", features=cells.select("cohort", "feature"), gaps="zero")
    keys, facts = vector_facts(rows)
    return facts.select(*keys, "width", "stored", "weighted")


@query(sql("""SELECT d.cohort, d.seed, d.sample_id, count(*) AS width, count(*) AS stored, round(sum(d.value * p.pos), 5) AS weighted
  FROM hour_dense d JOIN (SELECT cohort, seed, feature, row_number() OVER (PARTITION BY cohort, seed ORDER BY feature) AS pos FROM hour_median) p
    ON p.cohort = d.cohort AND p.seed = d.seed AND p.feature = d.feature GROUP BY 1, 2, 3""", "hour_dense"))
def assemble_imputed(spark, sf_dir):
    matrix, _, _, split = hour_inputs(spark, sf_dir)
    fill = cut_lineage(prepare.train_medians(matrix, split))
    filled = prepare.median_impute(matrix, split, fill)
    rows = prepare.assemble(filled, ["cohort", "seed", "sample_id"], "value", features=fill.select("cohort", "seed", "feature"), rows=split)
    keys, facts = vector_facts(rows)
    return facts.select(*keys, "width", "stored", "weighted")


@query(sql("""SELECT cohort, sample_id, label, len(list(feature)) AS width, round(list_sum(list(value ORDER BY feature)), 6) AS total,
  round(list_dot_product(list(value ORDER BY feature), list(CAST(CAST(substr(feature, 2) AS INTEGER) + 1 AS DOUBLE) ORDER BY feature)), 6) AS weighted
  FROM emb_cells GROUP BY 1, 2, 3""", "emb_cells"))
def assemble_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    cells = align.align(fx.emb_matrix(spark, sf_dir), fx.emb_samples(spark, sf_dir))
    rows = prepare.assemble(cells, ["cohort", "sample_id", "label"], "value").withColumn("a", vector_to_array("features"))
    weighted = F.aggregate(F.transform("a", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("cohort", "sample_id", "label", F.size("a").cast("bigint").alias("width"),
                       rounded(F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
                       rounded(weighted).alias("weighted"))


# ---- probabilities ----------------------------------------------------------------------------

def one_scores(spark, sf_dir):
    samples, matrix = fx.emb_samples(spark, sf_dir), fx.emb_matrix(spark, sf_dir)
    split = cut_lineage(splits.stratified_split(samples, fx.SEEDS))
    return fx.centroid_scores(matrix, split, moments.feature_stats(matrix, split, fx.SEEDS, samples))


def one_predictions(spark, sf_dir):
    return fx.centroid_predictions(one_scores(spark, sf_dir))


# broken probabilities derived from the scores: best class +inf or NaN, worst two NaN and -inf
cte("one_broken", f"""SELECT {RUN}, sample_id, class, CASE WHEN rn = 1 AND class = '0' THEN 'nan'::DOUBLE WHEN rn = 1 THEN 'inf'::DOUBLE
    WHEN rn = 10 THEN 'nan'::DOUBLE WHEN rn = 9 THEN '-inf'::DOUBLE WHEN best = '0' THEN 0 ELSE p END AS p FROM (
  SELECT *, row_number() OVER (PARTITION BY {RUN}, sample_id ORDER BY score DESC, class) AS rn,
    first_value(class) OVER (PARTITION BY {RUN}, sample_id ORDER BY score DESC, class) AS best FROM one_prob)""", "one_prob")
cte("one_clean", f"""SELECT {RUN}, sample_id, class, CASE WHEN isnan(p) THEN 0 WHEN p = 'inf'::DOUBLE THEN 1 WHEN p = '-inf'::DOUBLE THEN 0 ELSE p END AS p
  FROM one_broken""", "one_broken")


def broken_probabilities(spark, sf_dir):
    from pyspark.sql import Window
    long = metrics.softmax_scores(one_scores(spark, sf_dir), metrics.RUN_KEYS)
    order = Window.partitionBy(*metrics.RUN_KEYS, "sample_id").orderBy(F.col("score").desc(), "class")
    ranked = long.withColumn("rn", F.row_number().over(order)).withColumn("best", F.first("class").over(order))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    broken = (F.when((F.col("rn") == 1) & (F.col("class") == "0"), nan).when(F.col("rn") == 1, inf)
              .when(F.col("rn") == 10, nan).when(F.col("rn") == 9, -inf).when(F.col("best") == "0", 0.0).otherwise(F.col("p")))
    return ranked.select(*metrics.RUN_KEYS, "sample_id", "class", broken.alias("p"))


@query(sql(f"SELECT {RUN}, sample_id, class, {r6('p')} AS p FROM one_clean", "one_clean"))
def proba_cleanup(spark, sf_dir):
    return six(metrics.clean_probabilities(broken_probabilities(spark, sf_dir)), "p")


@query(sql(f"""SELECT {RUN}, sample_id, class, {r6('p / CASE WHEN t = 0 THEN 1 ELSE t END')} AS p FROM (
  SELECT *, sum(p) OVER (PARTITION BY {RUN}, sample_id) AS t FROM one_clean)""", "one_clean"))
def proba_normalise(spark, sf_dir):
    clean = metrics.clean_probabilities(broken_probabilities(spark, sf_dir))
    return six(metrics.normalise_probabilities(clean, metrics.RUN_KEYS), "p")


@query(sql(f"SELECT {RUN}, sample_id, class, {r6('score')} AS score, {r6('p')} AS p FROM one_prob", "one_prob"))
def softmax_scores(spark, sf_dir):
    long = metrics.softmax_scores(one_scores(spark, sf_dir), metrics.RUN_KEYS)
    return six(long.select(*metrics.RUN_KEYS, "sample_id", "class", "score", "p"), "score", "p")


# ---- evaluation -------------------------------------------------------------------------------

@query(sql(f"SELECT {RUN}, {r6s('accuracy', 'macro_f1', 'weighted_f1', 'macro_recall', 'weighted_recall')}, n_test FROM one_met", "one_met"))
def run_metrics(spark, sf_dir):
    return six(metrics.run_metrics(one_predictions(spark, sf_dir)),
               "accuracy", "macro_f1", "weighted_f1", "macro_recall", "weighted_recall")


@query(sql(f"SELECT {RUN}, class, n_pos, n_neg, {r6s('auc')} FROM one_auc", "one_auc"))
def roc_auc_ovr(spark, sf_dir):
    return six(metrics.class_auc(one_predictions(spark, sf_dir)), "auc")


@query(sql(f"SELECT {RUN}, class, n_pos, n_neg, {r6s('auc')} FROM one_small_auc", "one_small_auc"))
def roc_auc_saturated(spark, sf_dir):
    """Areas of probabilities that differ by less than 1e-9."""
    tiny = one_predictions(spark, sf_dir).withColumn("proba", F.transform_values("proba", lambda _, p: p * 1e-12))
    return six(metrics.class_auc(tiny), "auc")


@query(sql(f"SELECT {RUN}, {r6s('roc_auc_macro', 'roc_auc_weighted')} FROM one_avgauc", "one_avgauc"))
def roc_auc_macro_weighted(spark, sf_dir):
    return six(metrics.average_auc(metrics.class_auc(one_predictions(spark, sf_dir))), "roc_auc_macro", "roc_auc_weighted")


@query(f"""SELECT cohort, n_pos, n_neg, {r6('CASE WHEN n_pos > 0 AND n_neg > 0 THEN (ranks - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END')} AS auc FROM (
  SELECT cohort, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality <> 1) AS n_neg,
    sum(CASE WHEN quality = 1 THEN first_rank + (ties - 1) / 2.0::DOUBLE END) AS ranks FROM (
      SELECT d.lang AS cohort, l.quality, rank() OVER (PARTITION BY d.lang ORDER BY d.n_chars) AS first_rank,
        count(*) OVER (PARTITION BY d.lang, d.n_chars) AS ties
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY cohort)""")
def roc_auc_binary(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    scored = docs.join(fx.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(
        F.col("lang").alias("cohort"), (F.col("quality") == 1).alias("positive"), F.col("n_chars").cast("double").alias("score"))
    return six(metrics.score_auc(scored, ["cohort"], buckets=8), "auc")


@query(sql(f"""SELECT g.*, coalesce(c.n, 0) AS n FROM (SELECT a.*, b.class AS prediction FROM
    (SELECT {RUN}, class AS label FROM one_class) a JOIN one_class b ON {on('a', 'b', RUN)}) g
  LEFT JOIN one_conf c ON {on('g', 'c', RUN + ', label, prediction')}""", "one_class", "one_conf"))
def confusion(spark, sf_dir):
    return metrics.confusion_matrix(one_predictions(spark, sf_dir))


cte("sum_class", "SELECT DISTINCT cohort, class FROM one_class", "one_class")


@query(sql("""SELECT g.*, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT a.cohort, a.class AS label, b.class AS prediction FROM sum_class a JOIN sum_class b ON a.cohort = b.cohort) g
  LEFT JOIN (SELECT cohort, label, prediction, sum(n) AS n FROM one_conf GROUP BY ALL) c
    ON g.cohort = c.cohort AND g.label = c.label AND g.prediction = c.prediction""", "sum_class", "one_conf"))
def confusion_summed(spark, sf_dir):
    return metrics.confusion_matrix(one_predictions(spark, sf_dir), ["cohort"])


@query(sql("SELECT cohort, label, " + ", ".join(
    f"sum(CASE WHEN prediction = '{c}' THEN n ELSE 0 END)::BIGINT AS \"{c}\"" for c in range(10)) + " FROM one_conf GROUP BY 1, 2", "one_conf"))
def confusion_wide(spark, sf_dir):
    return metrics.confusion_wide(one_predictions(spark, sf_dir), [str(c) for c in range(10)], ["cohort"])


@query(sql(f"""SELECT {RUN}, class, {r6s('"precision"', 'recall', 'f1').replace('AS "precision"', 'AS precision')}, support FROM one_class
  UNION ALL SELECT {RUN}, 'accuracy', NULL, NULL, {r6('accuracy')}, n_test FROM one_met
  UNION ALL SELECT {RUN}, 'macro avg', {r6('avg("precision")')}, {r6('avg(recall)')}, {r6('avg(f1)')}, sum(support)::BIGINT FROM one_class GROUP BY ALL
  UNION ALL SELECT {RUN}, 'weighted avg', {r6('sum("precision" * support) / sum(support)')}, {r6('sum(recall * support) / sum(support)')},
    {r6('sum(f1 * support) / sum(support)')}, sum(support)::BIGINT FROM one_class GROUP BY ALL""", "one_class", "one_met"))
def class_report(spark, sf_dir):
    return six(metrics.class_report(one_predictions(spark, sf_dir)), "precision", "recall", "f1")


# ---- run table and reports --------------------------------------------------------------------

M7 = reports.METRICS
RUN_COLUMNS = ("cohort, method, param, seed, run_id, n_features_total, n_features, " + r6s(*M7)
               + ", train_time_s, run_time_s, status")


@query(sql(f"SELECT {RUN_COLUMNS} FROM runs", "runs"))
def run_table(spark, sf_dir):
    return six(fx.run_table(spark, sf_dir), *M7)


@query(sql(f"SELECT cohort, param, seed, n_features, {r6s(*M7)} FROM runs WHERE method = 'variance'", "runs"))
def sweep_series(spark, sf_dir):
    return six(reports.sweep_series(fx.run_table(spark, sf_dir), "variance"), *M7)


cte("runs_long", "SELECT cohort, method, param, seed, run_id, metric, value FROM (" + " UNION ALL ".join(
    f"SELECT cohort, method, param, seed, run_id, '{m}' AS metric, {m} AS value FROM runs" for m in M7) + ")", "runs")


@query(sql(f"SELECT cohort, method, param, run_id, metric, {r6('value')} AS value FROM runs_long", "runs_long"))
def per_run_series(spark, sf_dir):
    return six(reports.per_run_series(fx.run_table(spark, sf_dir)), "value")


AGGREGATED = [*M7, *reports.TIMES, "n_features"]


def aggregate_columns(std: str = "{}") -> str:
    kinds = (("mean", "avg({})"), ("std", std.format("stddev_samp({})")), ("min", "min({})"), ("max", "max({})"))
    return ", ".join(f"{r6(call.format(m))} AS {m}_{kind}" for m in AGGREGATED for kind, call in kinds)


def rounded_summary(summary):
    return summary.select([rounded(f.name).alias(f.name) if f.dataType.simpleString() == "double"
                           else F.col(f.name) for f in summary.schema.fields])


def feature_bounds_as_double(summary):
    return summary.withColumns({f"n_features_{k}": F.col(f"n_features_{k}").cast("double") for k in ("min", "max")})


@query(sql(f"SELECT cohort, method, param, {aggregate_columns()}, count(DISTINCT run_id) AS n_runs, count(*) AS n_rows FROM (SELECT * REPLACE (n_features::DOUBLE AS n_features) FROM runs) GROUP BY 1, 2, 3", "runs"))
def aggregate_runs(spark, sf_dir):
    return rounded_summary(feature_bounds_as_double(reports.aggregate_runs(fx.run_table(spark, sf_dir))))


@query(sql(f"SELECT cohort, method, param, seed, {aggregate_columns('coalesce({}, 0)')}, count(DISTINCT run_id) AS n_runs, count(*) AS n_rows FROM (SELECT * REPLACE (n_features::DOUBLE AS n_features) FROM runs) GROUP BY 1, 2, 3, 4", "runs"))
def aggregate_runs_reported(spark, sf_dir):
    single = reports.aggregate_runs(fx.run_table(spark, sf_dir), [*reports.SETTING, "seed"])
    return rounded_summary(feature_bounds_as_double(reports.reported(single)))


@query(sql("SELECT cohort, method, " + ", ".join(f"{r6(f'avg({m})')} AS {m}_mean, {r6(f'stddev_samp({m})')} AS {m}_std"
                                                 for m in [*M7, "n_features", "train_time_s"]) + " FROM runs GROUP BY 1, 2", "runs"))
def mean_std_runs(spark, sf_dir):
    return rounded_summary(reports.mean_std(fx.run_table(spark, sf_dir)))


@query(sql(f"""SELECT cohort, metric, count(value) AS count, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std, {r6('min(value)')} AS min,
  {r6('quantile_cont(value, 0.25)')} AS p25, {r6('quantile_cont(value, 0.5)')} AS p50, {r6('quantile_cont(value, 0.75)')} AS p75, {r6('max(value)')} AS max
  FROM runs_long GROUP BY 1, 2""", "runs_long"))
def describe_runs(spark, sf_dir):
    return rounded_summary(reports.describe_runs(fx.run_table(spark, sf_dir)))


@query(sql(f"""SELECT cohort, method, {r6('sum(train_time_s)')} AS train_time_s_total, {r6('sum(run_time_s)')} AS run_time_s_total, count(*) AS n_rows
  FROM runs GROUP BY 1, 2""", "runs"))
def total_times(spark, sf_dir):
    return rounded_summary(reports.total_times(fx.run_table(spark, sf_dir)))


@query(sql(f"""SELECT method, cohort, metric, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std, {r6('min(value)')} AS min, {r6('max(value)')} AS max
  FROM runs_long GROUP BY 1, 2, 3""", "runs_long"))
def summary_long(spark, sf_dir):
    return rounded_summary(reports.summary_long(fx.run_table(spark, sf_dir)))


@query(sql(f"SELECT method, metric, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std_pop FROM runs_long GROUP BY 1, 2", "runs_long"))
def pooled_methods(spark, sf_dir):
    return rounded_summary(reports.compare_methods(fx.run_table(spark, sf_dir), by_cohort=False))


@query(sql(f"SELECT cohort, method, metric, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std_pop FROM runs_long GROUP BY 1, 2, 3", "runs_long"))
def cohort_methods(spark, sf_dir):
    return rounded_summary(reports.compare_methods(fx.run_table(spark, sf_dir), by_cohort=True))


@query(sql(f"""SELECT c.cohort, m.method, {r6('coalesce(avg(r.n_features), 0)')} AS n_features FROM (SELECT DISTINCT cohort FROM runs) c,
  (SELECT unnest(['anova', 'baseline', 'forward', 'variance']) AS method) m LEFT JOIN runs r ON r.cohort = c.cohort AND r.method = m.method GROUP BY 1, 2""", "runs"))
def feature_counts(spark, sf_dir):
    return rounded_summary(reports.feature_counts(fx.run_table(spark, sf_dir), ["anova", "baseline", "forward", "variance"]))


@query(sql("SELECT cohort, method, criterion, param, seed, " + r6("value") + """ AS value FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, method, criterion ORDER BY CASE WHEN criterion = 'run_time_s' THEN value ELSE -value END, param, seed) AS rn FROM (""" + " UNION ALL ".join(
    f"SELECT cohort, method, param, seed, '{c}' AS criterion, round({c}, 9) AS value FROM runs WHERE {c} IS NOT NULL"
    for c in ("accuracy", "macro_f1", "roc_auc_macro", "run_time_s")) + ")) WHERE rn = 1", "runs"))
def best_setting(spark, sf_dir):
    runs = fx.run_table(spark, sf_dir).withColumns({c: rounded(c, 9) for c in ("accuracy", "macro_f1", "roc_auc_macro")})
    return rounded_summary(reports.best_setting(runs))


@query(sql(f"SELECT {RUN_COLUMNS} FROM runs WHERE (cohort IN ('C0', 'C1') AND method = 'anova') OR (cohort NOT IN ('C0', 'C1') AND method <> 'anova')", "runs"))
def merge_old_new_runs(spark, sf_dir):
    runs = fx.run_table(spark, sf_dir)
    new = runs.where((F.col("method") == "anova") & F.col("cohort").isin("C0", "C1"))
    merged = reports.prefer_new(new, runs.where(F.col("method") != "anova"))
    return six(merged.select(*runs.columns), *M7)


@query(sql(f"""SELECT cohort, CASE method WHEN 'anova' THEN 'ANOVA' WHEN 'variance' THEN 'RandomForest' ELSE method END AS method,
  replace(param, 'tau=', 'threshold=') AS param, seed, n_features, {r6s('accuracy', 'macro_f1', 'weighted_f1')}, {r6('roc_auc_macro')} AS roc_auc,
  CASE WHEN method <> 'anova' THEN {r6('roc_auc_macro')} END AS roc_auc_weighted, CASE WHEN method = 'anova' THEN {r6('roc_auc_macro')} END AS roc_auc_macro,
  run_time_s FROM runs""", "runs"))
def canonical_methods(spark, sf_dir):
    """A run table under its older headings; the area is the weighted one for the baseline and the forest."""
    old_names = F.when(F.col("method") == "anova", "ANOVA / F-test").when(F.col("method") == "variance", "Random Forest").otherwise(F.col("method"))
    number = F.regexp_extract("param", "=(.*)", 1)
    old = fx.run_table(spark, sf_dir).select(
        F.col("cohort").alias("Cancer"), old_names.alias("Method"), F.when(F.col("method") == "anova", number).alias("Top K"),
        F.when(F.col("method") == "variance", number).alias("Threshold"), F.col("seed").alias("Seed"),
        F.col("n_features").alias("Selected Features"), F.col("accuracy").alias("Accuracy"), F.col("macro_f1").alias("Macro F1"),
        F.col("weighted_f1").alias("Weighted F1"), F.col("roc_auc_macro").alias("ROC-AUC"), F.col("run_time_s").alias("Runtime (s)"))
    return six(reports.canonical(old), "accuracy", "macro_f1", "weighted_f1", "roc_auc", "roc_auc_weighted", "roc_auc_macro")


# ---- mutual information -----------------------------------------------------------------------

cte("mi_points", f"""SELECT *, value / unit + 1e-10::DOUBLE * greatest(1.0::DOUBLE, size / unit)
    * (CAST(('0x' || substr(md5(sample_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE) AS x FROM (
  SELECT *, count(*) OVER (PARTITION BY cohort, seed, feature, label) AS class_size, avg(abs(value)) OVER (PARTITION BY cohort, seed, feature) AS size,
    coalesce(nullif(stddev_pop(value) OVER (PARTITION BY cohort, seed, feature), 0), 1) AS unit FROM emb_train)""", "emb_train")
cte("mi_radius", f"""SELECT cohort, seed, feature, sample_id, x, class_size, k, list_sort(distances)[k] AS r FROM (
  SELECT p.cohort, p.seed, p.feature, p.sample_id, p.x, p.class_size, least(3, p.class_size - 1) AS k, list(abs(p.x - q.x)) AS distances
  FROM mi_points p JOIN mi_points q ON {on('p', 'q', 'cohort, seed, feature, label')} AND p.sample_id <> q.sample_id
  WHERE p.class_size > 1 GROUP BY ALL)""", "mi_points")
cte("mi_count", f"""SELECT p.cohort, p.seed, p.feature, p.sample_id, p.class_size, p.k, count(*) AS m
  FROM mi_radius p JOIN mi_radius q ON {on('p', 'q', 'cohort, seed, feature')} AND abs(p.x - q.x) < p.r GROUP BY ALL""", "mi_radius")
cte("mi_psi", """SELECT n, coalesce(sum(1.0::DOUBLE / (n - 1)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS psi
  FROM (SELECT unnest(range(2, (SELECT count(*) + 2 FROM embeddings))) AS n)""")
cte("mi_psi1", "SELECT 1 AS n, 0.0::DOUBLE AS psi UNION ALL SELECT n, psi FROM mi_psi", "mi_psi")
cte("mi_score", """SELECT c.cohort, c.seed, c.feature, greatest(0, any_value(t.psi) + avg(a.psi) - avg(b.psi) - avg(d.psi)) AS score
  FROM mi_count c JOIN (SELECT cohort, seed, feature, count(*) AS n FROM mi_count GROUP BY ALL) g
    ON c.cohort = g.cohort AND c.seed = g.seed AND c.feature = g.feature
  JOIN mi_psi1 t ON t.n = g.n JOIN mi_psi1 a ON a.n = c.k JOIN mi_psi1 b ON b.n = c.class_size JOIN mi_psi1 d ON d.n = c.m
  GROUP BY ALL""", "mi_count", "mi_psi1")


def emb_information(spark, sf_dir, buckets=1, unit=1.0):
    split = emb_split(spark, sf_dir)
    matrix = fx.emb_matrix(spark, sf_dir).withColumn("value", F.col("value") * unit)
    return information.mutual_information(prepare.train_cells(matrix, split), buckets)


MUTUAL_INFO = sql(f"SELECT cohort, seed, feature, {r6('score')} AS score FROM mi_score", "mi_score")


@query(MUTUAL_INFO)
def mutual_info(spark, sf_dir):
    return six(emb_information(spark, sf_dir), "score")


@query(MUTUAL_INFO)
def mutual_info_small_units(spark, sf_dir):
    """The scores of values divided by 2^40: the unit decides nothing."""
    return six(emb_information(spark, sf_dir, unit=2.0 ** -40), "score")


@query(sql(f"""SELECT cohort, seed, feature, {r6('score')} AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed ORDER BY sig(score) DESC, feature DESC) AS rn FROM mi_score) WHERE rn <= 20""", "mi_score"))
def mutual_info_top_k(spark, sf_dir):
    return six(selection.top_k(emb_information(spark, sf_dir), 20), "score")


# ---- forward selection ------------------------------------------------------------------------

cte("fs_fold", """SELECT cohort, seed, sample_id, label, CAST((rn - 1) % 2 AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed, label ORDER BY md5('fold:' || CAST(seed AS VARCHAR) || ':' || sample_id), sample_id) AS rn
  FROM emb_split WHERE part = 'train')""", "emb_split")
cte("fs_rows", f"""SELECT a.cohort, a.seed, a.fold, a.label, c.feature, c.value
  FROM (SELECT cohort, seed, sample_id, label, 1 - fold AS fold FROM fs_fold) a JOIN emb_cells c ON {on('a', 'c', 'cohort, sample_id')}""", "fs_fold", "emb_cells")
cte("fs_most", """SELECT cohort, seed, fold, max(var) * 1e-9::DOUBLE AS added FROM (
  SELECT cohort, seed, fold, feature, var_pop(value) AS var FROM fs_rows GROUP BY ALL) GROUP BY ALL""", "fs_rows")
cte("fs_fit", f"""SELECT r.cohort, r.seed, r.fold, r.feature, r.label AS class, avg(r.value) AS mean, var_pop(r.value) + any_value(m.added) AS var
  FROM fs_rows r JOIN fs_most m ON {on('r', 'm', 'cohort, seed, fold')} GROUP BY r.cohort, r.seed, r.fold, r.feature, r.label""", "fs_rows", "fs_most")
cte("fs_prior", """SELECT cohort, seed, fold, class, ln(n / sum(n) OVER (PARTITION BY cohort, seed, fold)) AS lp FROM (
  SELECT cohort, seed, 1 - fold AS fold, label AS class, count(*)::DOUBLE AS n FROM fs_fold GROUP BY ALL)""", "fs_fold")
cte("fs_term", f"""SELECT f.cohort, f.seed, f.fold, f.sample_id, f.label, c.feature, m.class,
    -0.5::DOUBLE * ln(2 * pi() * m.var) - (c.value - m.mean) * (c.value - m.mean) / (2 * m.var) AS term
  FROM fs_fold f JOIN emb_cells c ON {on('f', 'c', 'cohort, sample_id')} JOIN fs_fit m ON {on('m', 'f', 'cohort, seed, fold')} AND m.feature = c.feature""",
    "fs_fold", "emb_cells", "fs_fit")
cte("fs_run0", f"""SELECT f.cohort, f.seed, f.fold, f.sample_id, p.class, p.lp AS total FROM fs_fold f JOIN fs_prior p ON {on('f', 'p', 'cohort, seed, fold')}""",
    "fs_fold", "fs_prior")
#: a fifth of the 64 features, as the method takes of its candidates
STEPS = 12
#: with a trained model for every candidate; the README says what a step takes
TRAINED_STEPS = 4
for step in range(1, STEPS + 1):
    last = f"fs_chosen{step - 1}"
    cte(f"fs_pred{step}", f"""SELECT cohort, seed, fold, feature, sample_id, label, class AS prediction FROM (SELECT t.*, row_number() OVER (
        PARTITION BY t.cohort, t.seed, t.fold, t.feature, t.sample_id ORDER BY round(r.total + t.term, 9) DESC, t.class) AS rn
      FROM fs_term t JOIN fs_run{step - 1} r ON {on('t', 'r', 'cohort, seed, fold, sample_id, class')}
      {f"WHERE NOT EXISTS (SELECT 1 FROM {last} b WHERE {on('b', 't', 'cohort, seed, feature')})" if step > 1 else ""}) WHERE rn = 1""",
        "fs_term", f"fs_run{step - 1}", *([last] if step > 1 else []))
    cte(f"fs_f1_{step}", f"""SELECT cohort, seed, fold, feature, avg(2.0::DOUBLE * tp / (support + predicted)) AS f1 FROM (
      SELECT cohort, seed, fold, feature, class, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (
        SELECT cohort, seed, fold, feature, label AS class, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS p FROM fs_pred{step}
        UNION ALL SELECT cohort, seed, fold, feature, prediction, 0, 0, 1 FROM fs_pred{step}) GROUP BY ALL) GROUP BY ALL""", f"fs_pred{step}")
    cte(f"fs_best{step}", f"""SELECT cohort, seed, feature, score FROM (SELECT *, row_number() OVER (PARTITION BY cohort, seed ORDER BY round(score, 9) DESC, feature) AS rn
      FROM (SELECT cohort, seed, feature, avg(f1) AS score FROM fs_f1_{step} GROUP BY ALL)) WHERE rn = 1""", f"fs_f1_{step}")
    cte(f"fs_chosen{step}", f"SELECT cohort, seed, {step} AS rank, feature, score FROM fs_best{step}" + (f" UNION ALL SELECT * FROM {last}" if step > 1 else ""),
        f"fs_best{step}", *([last] if step > 1 else []))
    cte(f"fs_run{step}", f"""SELECT r.cohort, r.seed, r.fold, r.sample_id, r.class, r.total + t.term AS total FROM fs_run{step - 1} r
      JOIN fs_term t ON {on('t', 'r', 'cohort, seed, fold, sample_id, class')} JOIN fs_best{step} b ON {on('b', 't', 'cohort, seed, feature')}""",
        f"fs_run{step - 1}", "fs_term", f"fs_best{step}")

FORWARD = sql(f"SELECT cohort, seed, rank, feature, {r6('score')} AS score FROM fs_chosen{STEPS}", f"fs_chosen{STEPS}")


def two_folds(spark, sf_dir):
    return splits.stratified_folds(emb_split(spark, sf_dir).where(F.col("part") == "train").drop("part"), 2)


@query(FORWARD)
def forward_selection_nb(spark, sf_dir):
    return six(forward.forward_selection(fx.emb_matrix(spark, sf_dir), two_folds(spark, sf_dir), steps=STEPS, folds=2), "score")


@query(FORWARD)
def forward_small_units(spark, sf_dir):
    """The same selection from values a million times smaller."""
    small = fx.emb_matrix(spark, sf_dir).withColumn("value", F.col("value") * 1e-6)
    return six(forward.forward_selection(small, two_folds(spark, sf_dir), steps=STEPS, folds=2), "score")


@query()
def forward_selection_trained(spark, sf_dir):
    """A logistic model trained for every candidate, fold and step; a test holds it against one fit after another."""
    vectors = varying_vectors(spark, sf_dir).select("cohort", "seed", "sample_id", "features")
    candidates = scores.varying_features(emb_moments(spark, sf_dir)).select("cohort", "seed", "feature")
    return forward.forward_selection_logistic(vectors, two_folds(spark, sf_dir), candidates, TRAINED_STEPS, 2)


# ---- trained models: no SQL twin, checked by tests on separable data --------------------------

def one_seed(spark, sf_dir):
    return benchmark.prepared(fx.emb_matrix(spark, sf_dir), fx.emb_samples(spark, sf_dir), fx.SEEDS[:1])


def trained(spark, sf_dir, *methods):
    outcome = benchmark.run_benchmark(one_seed(spark, sf_dir), methods)
    return outcome.runs.drop("train_time_s", "run_time_s")


def model_facts(spark, sf_dir, *methods):
    """What is exact about trained runs, for all seeds: sizes, and that predictions follow from probabilities."""
    p = benchmark.prepared(fx.emb_matrix(spark, sf_dir), fx.emb_samples(spark, sf_dir), fx.SEEDS)
    outcome = benchmark.run_benchmark(p, methods)
    classes, values = F.map_keys("proba"), F.map_values("proba")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    best = F.array_min(F.filter(classes, lambda c: F.element_at("proba", c) == F.array_max(values)))
    facts = outcome.predictions.groupBy(*metrics.RUN_KEYS).agg(
        F.count("*").alias("n_test"), F.every(F.abs(total - 1) < 1e-9).alias("sums_to_one"), F.every(F.col("prediction") == best).alias("best_class"))
    runs = outcome.runs.select(*metrics.RUN_KEYS, "n_features", "status")
    return runs.join(facts, metrics.RUN_KEYS).select(*metrics.RUN_KEYS, "n_features", "n_test", "sums_to_one", "best_class", "status")


def facts_twin(sets: str) -> str:
    """The twin for feature sets given as (cohort, seed, method, param, n_features)."""
    return sql(f"""SELECT s.cohort, s.seed, s.method, s.param, CAST(s.n_features AS INTEGER) AS n_features, t.n_test, true AS sums_to_one, true AS best_class, 'ok' AS status
      FROM ({sets}) s JOIN (SELECT cohort, seed, count(*) AS n_test FROM emb_split WHERE part = 'test' GROUP BY ALL) t ON t.cohort = s.cohort AND t.seed = s.seed""",
               "emb_mom", "emb_split")


@query(facts_twin("SELECT cohort, seed, 'baseline' AS method, 'all' AS param, count(*) AS n_features FROM emb_mom GROUP BY ALL"))
def baseline_facts(spark, sf_dir):
    return model_facts(spark, sf_dir, benchmark.baseline())


@query(facts_twin("""SELECT DISTINCT cohort, seed, unnest(['anova', 'mutual_info']) AS method, 'k=20' AS param, 20 AS n_features FROM emb_mom"""))
def filter_facts(spark, sf_dir):
    return model_facts(spark, sf_dir, benchmark.anova(20), benchmark.mutual_info(20))


@query(sql(f"""SELECT cohort, seed, feature, {r6('score')} AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY cohort, seed ORDER BY sig(score) DESC, feature DESC) AS rn FROM (SELECT cohort, seed, feature, between_ss AS score FROM emb_mom)) WHERE rn <= 10""", "emb_mom"))
def user_scorer(spark, sf_dir):
    """A user's own score, registered under a name: the spread between the classes."""
    @scores.scorer("between_classes")
    def between_classes(summary):
        return summary.select(*scores.KEYS, F.col("between").alias("score"))

    return six(selection.top_k(scores.SCORERS["between_classes"](emb_moments(spark, sf_dir)), 10, buckets=4), "score")


@query(sql(f"SELECT cohort, method, param, seed, run_id, n_features, {r6s('accuracy', 'macro_f1', 'roc_auc_macro')} FROM runs", "runs"))
def run_files_reread(spark, sf_dir):
    """The run table written as one file set per method and run, and read back by column name."""
    import uuid

    from widesift.session import checkpoint_folder
    from widesift.sources import runs as run_files
    folder = f"{checkpoint_folder(spark)}/runs-{uuid.uuid4().hex}"
    run_files.write_run_files(fx.run_table(spark, sf_dir).withColumns({"named": F.col("method"), "number": F.col("run_id")}), folder)
    back = run_files.read_runs(spark, f"{folder}/*/*/*.csv")
    rows = back.select("cohort", F.col("named").alias("method"), "param", "seed", F.col("number").cast("int").alias("run_id"), "n_features",
                       "accuracy", "macro_f1", "roc_auc_macro")
    return six(rows, "accuracy", "macro_f1", "roc_auc_macro")


@query()
def baseline_lr(spark, sf_dir):
    return trained(spark, sf_dir, benchmark.baseline())


@query()
def filter_lr(spark, sf_dir):
    return trained(spark, sf_dir, benchmark.anova(20), benchmark.mutual_info(20))


def every_seed(spark, sf_dir):
    return benchmark.prepared(fx.emb_matrix(spark, sf_dir), fx.emb_samples(spark, sf_dir), fx.SEEDS)


@query()
def ovr_lr(spark, sf_dir):
    return benchmark.run_benchmark(every_seed(spark, sf_dir), [benchmark.variance_threshold([0.015, 0.016])]).runs.drop("train_time_s", "run_time_s")


@query()
def ovr_lr_softmax(spark, sf_dir):
    return benchmark.run_benchmark(every_seed(spark, sf_dir), [benchmark.select_k_best([0.5])]).runs.drop("train_time_s", "run_time_s")


@query(sql("""SELECT DISTINCT cohort, seed, 'select_k_best' AS method, 'fraction=0.5' AS param, 50 AS passes, 51 AS n_losses, true AS falling FROM emb_split""", "emb_split"))
def ovr_passes(spark, sf_dir):
    """Fifty passes over the training rows of every run, none of which raises the loss."""
    p = every_seed(spark, sf_dir)
    sets = benchmark.select_k_best([0.5]).select(p).withColumn("method", F.lit("select_k_best"))
    states = stochastic.fitted(stochastic.run_blocks(p.vectors(sets), "train"), models.STOCHASTIC["one_vs_rest_50"])
    falls = F.forall(F.sequence(F.lit(1), F.size("losses") - 1), lambda i: F.get("losses", i) <= F.get("losses", i - 1))
    return states.select(*metrics.RUN_KEYS, "passes", F.size("losses").alias("n_losses"), falls.alias("falling"))


@query()
def forward_lr(spark, sf_dir):
    return trained(spark, sf_dir, benchmark.forward_selection(fraction=0.05))


@query()
def evaluate_feature_set(spark, sf_dir):
    """Predictions of the standard evaluator for one feature set per cohort."""
    p = one_seed(spark, sf_dir)
    best = selection.top_k(scores.anova_scores(p.moments), 20)
    sets = best.select("cohort", "seed", F.lit("given").alias("method"), F.lit("k=20").alias("param"), "feature")
    predictions, _ = benchmark.evaluate_feature_sets(p, sets, "logistic")
    return predictions.select(*metrics.RUN_KEYS, "sample_id", "label", "prediction",
                              F.map_values("proba").alias("proba"))


@query()
def lasso_select(spark, sf_dir):
    return benchmark.lasso().select(benchmark.prepared(fx.emb_matrix(spark, sf_dir), fx.emb_samples(spark, sf_dir), fx.SEEDS))


def varying_vectors(spark, sf_dir):
    p = benchmark.prepared(fx.emb_matrix(spark, sf_dir), fx.emb_samples(spark, sf_dir), fx.SEEDS)
    varying = scores.varying_features(p.moments).withColumns({"method": F.lit("tuning"), "param": F.lit("all")})
    return cut_lineage(models.build_vectors(p.matrix, p.split, varying, p.moments))


@query()
def lasso_c_sweep(spark, sf_dir):
    return embedded.lasso_sweep(varying_vectors(spark, sf_dir))


@query(sql("SELECT DISTINCT cohort, seed, CAST(c AS DOUBLE) AS c, true AS converged, true AS optimal FROM emb_split, (SELECT unnest([0.1, 0.05, 0.01]) AS c)", "emb_split"))
def lasso_optimal(spark, sf_dir):
    """Whether every model of the sweep meets the condition of its minimum in all columns, the screened ones included."""
    found = embedded.lasso_violations(varying_vectors(spark, sf_dir))
    return found.select("cohort", "seed", "c", "converged", (F.col("violation") < 1e-4).alias("optimal"))


@query()
def rf_select(spark, sf_dir):
    return benchmark.random_forest(trees=(20, 40), depths=(5, 10)).select(one_seed(spark, sf_dir))
