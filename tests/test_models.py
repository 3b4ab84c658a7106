import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from widesift.operators import embedded, metrics, models, prepare, reports, selection
from widesift.plans import benchmark


@pytest.fixture(scope="module")
def separable(spark):
    """Three classes; feature f<k> is shifted for class k, the other features are noise."""
    rng = random.Random(11)
    labels = {f"s{i:03d}": f"c{i % 3}" for i in range(90)}
    cells = [("X", s, f"f{f}", rng.gauss(0, 1) + 4.0 * (int(c[1]) == f)) for s, c in labels.items() for f in range(6)]
    cells += [("X", s, "flat", 1.0) for s in labels]
    matrix = spark.createDataFrame(cells, "cohort string, sample_id string, feature string, value double")
    samples = spark.createDataFrame([("X", s, c) for s, c in labels.items()], "cohort string, sample_id string, label string")
    return benchmark.prepared(matrix, samples, [42])


@pytest.mark.parametrize("name", sorted(models.CLASSIFIERS))
def test_classifiers_beat_the_majority(separable, name):
    sets = separable.moments.select("cohort", "seed", F.lit("m").alias("method"), F.lit("p").alias("param"), "feature")
    predictions, log = benchmark.evaluate_feature_sets(separable, sets, name)
    row = metrics.evaluate(predictions).first()
    assert row["accuracy"] > 0.8 and row["roc_auc_macro"] > 0.9 and row["n_test"] == 27
    assert row["accuracy"] == pytest.approx(row["weighted_recall"])
    sums = predictions.select(F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    assert log.first()["status"] == "ok"



@pytest.fixture(autouse=True)
def few_passes(monkeypatch):
    """The flow is under test here; test_stochastic.py trains until the loss stands still."""
    monkeypatch.setattr(models, "STOCHASTIC", {k: dataclasses.replace(v, passes=8) for k, v in models.STOCHASTIC.items()})


def test_benchmark_records_every_setting(separable):
    methods = [benchmark.baseline(), benchmark.variance_threshold([0.5, 1000.0]), benchmark.anova(3),
               benchmark.mutual_info(3), benchmark.select_k_best([0.5])]
    outcome = benchmark.run_benchmark(separable, methods)
    runs = {(r["method"], r["param"]): r for r in outcome.runs.collect()}
    assert len(runs) == 6 and outcome.runs.columns == [f.split()[0] for f in reports.RUN_SCHEMA.split(", ")]
    assert runs["baseline", "all"]["n_features"] == runs["baseline", "all"]["n_features_total"] == 7
    assert runs["variance", "threshold=0.5"]["n_features"] == 6
    empty = runs["variance", "threshold=1000"]
    assert (empty["n_features"], empty["accuracy"], empty["status"]) == (0, None, "empty")
    for method in ("anova", "mutual_info"):
        assert runs[method, "k=3"]["accuracy"] > 0.8
        chosen = outcome.feature_sets.where(F.col("method") == method).collect()
        assert {r["feature"] for r in chosen} == {"f0", "f1", "f2"}
    assert runs["select_k_best", "fraction=0.5"]["n_features"] == 3


def test_embedded_selection_finds_the_shifted_features(separable):
    lasso = {r["feature"] for r in benchmark.lasso(strengths=(1e-2, 1.0)).select(separable).collect()}
    assert {"f0", "f1", "f2"} <= lasso and "flat" not in lasso
    forest = {r["feature"] for r in benchmark.random_forest(trees=(10,), depths=(5, None)).select(separable).collect()}
    assert forest == {"f0", "f1", "f2"}


@pytest.mark.parametrize("scorer", ["naive_bayes", "logistic"])
def test_forward_selection_method(separable, scorer):
    found = benchmark.forward_selection(fraction=0.34, prefilter=6, scorer=scorer).select(separable)
    assert found.count() == 2 and found.where("feature IN ('f0', 'f1', 'f2')").count() >= 2


def test_fixed_strengths_report_both_counts(separable):
    sets = separable.moments.where("feature <> 'flat'").select("cohort", "seed", F.lit("m").alias("method"), F.lit("p").alias("param"), "feature")
    vectors = models.build_vectors(separable.matrix, separable.split, sets, separable.moments)
    rows = {r["c"]: r for r in embedded.lasso_sweep(vectors, (1.0, 0.001)).collect()}
    assert rows[1.0]["n_coefficients"] >= rows[1.0]["n_features"] >= 3 and rows[0.001]["n_features"] == 0
    assert rows[1.0]["accuracy"] > 0.8


def test_macro_f1_evaluator(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 3.0)]
    assert models.MacroF1().evaluate(spark.createDataFrame(rows, "_y double, prediction double")) == pytest.approx((2 / 3 + 2 / 3) / 4)


def test_a_failed_fit_is_recorded(separable):
    def broken(n):
        raise ValueError("no estimator")

    sets = separable.moments.select("cohort", "seed", F.lit("m").alias("method"), F.lit("p").alias("param"), "feature")
    vectors = models.build_vectors(separable.matrix, separable.split, sets, separable.moments)
    [fit] = models.fit_runs(vectors, lambda keys: models.Classifier(broken))
    assert fit.status == "failed: ValueError: no estimator" and fit.predictions is None
    assert models.fit_log(vectors, [fit]).first()["status"] == "failed: ValueError: no estimator"


def test_nonzero_mask_reads_coefficients(spark):
    table = spark.createDataFrame([("X", 1, "a", 0.0), ("X", 1, "b", 0.2)], "cohort string, seed int, feature string, score double")
    assert [r["feature"] for r in selection.nonzero(table).collect()] == ["b"]


def test_a_method_that_fails_is_recorded(separable):
    def broken(p):
        raise KeyError("score")

    outcome = benchmark.run_benchmark(separable, [benchmark.anova(3), benchmark.scored("mine", broken, 2)])
    status = {r["method"]: r["status"] for r in outcome.runs.collect()}
    assert status["anova"] == "ok" and status["mine"].startswith("failed: KeyError")


def test_gaps_are_filled_for_the_selected_features_only(spark):
    rng = random.Random(13)
    labels = {f"s{i:03d}": f"c{i % 2}" for i in range(60)}
    cells = [("X", s, f"f{f}", rng.gauss(0, 1) + 4.0 * (int(c[1]) == f)) for s, c in labels.items() for f in range(4) if rng.random() > 0.2]
    p = benchmark.prepared(spark.createDataFrame(cells, "cohort string, sample_id string, feature string, value double"),
                           spark.createDataFrame([("X", s, c) for s, c in labels.items()], "cohort string, sample_id string, label string"),
                           [42], impute=True)
    assert p.cells().count() == 60 * 4
    outcome = benchmark.run_benchmark(p, [benchmark.select_k_best([0.5])])
    row = outcome.runs.first()
    assert row["n_features"] == 2 and row["accuracy"] > 0.8
    assert outcome.predictions.count() == 18


def gappy(spark, share):
    rng = random.Random(3)
    labels = {f"s{i:03d}": f"c{i % 2}" for i in range(60)}
    cells = [("X", s, f"f{f}", rng.gauss(0, 1) + 4.0 * (int(c[1]) == f)) for s, c in labels.items() for f in range(6) if rng.random() > share]
    return (spark.createDataFrame(cells, "cohort string, sample_id string, feature string, value double"),
            spark.createDataFrame([("X", s, c) for s, c in labels.items()], "cohort string, sample_id string, label string"))


@pytest.mark.parametrize("gaps", ["zero", "median"])
def test_every_test_row_is_predicted_however_many_gaps(spark, gaps):
    p = benchmark.prepared(*gappy(spark, 0.6), [42, 43], gaps=gaps)
    outcome = benchmark.run_benchmark(p, [benchmark.anova(1), benchmark.baseline(), benchmark.mutual_info(2)])
    assert {r["status"] for r in outcome.runs.collect()} == {"ok"}
    wanted = {(r["seed"], r["sample_id"]) for r in p.split.where("part = 'test'").collect()}
    for method in ("anova", "baseline", "mutual_info"):
        found = [(r["seed"], r["sample_id"]) for r in outcome.predictions.where(F.col("method") == method).collect()]
        assert len(found) == len(wanted) and set(found) == wanted


def test_a_gap_is_an_error_with_its_message(spark):
    p = benchmark.prepared(*gappy(spark, 0.1), [42])
    with pytest.raises(RuntimeError, match="no method could be run") as raised:
        benchmark.run_benchmark(p, [benchmark.baseline()])
    assert "features" in str(raised.value.__cause__)


def test_places_in_vectors(spark):
    cells = spark.createDataFrame([("s1", "a", 1.0), ("s1", "b", 2.0), ("s1", "c", 3.0), ("s2", "b", 5.0), ("s2", "c", None)],
                                  "sample_id string, feature string, value double")
    rows = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    got = {r["sample_id"]: list(r["features"]) for r in prepare.assemble(cells, ["sample_id"], "value", rows=rows, gaps="zero").collect()}
    assert got == {"s1": [1.0, 2.0, 3.0], "s2": [0.0, 5.0, 0.0], "s3": [0.0, 0.0, 0.0]}
    with pytest.raises(Exception, match="a sample has 1 of 3 features"):
        prepare.assemble(cells, ["sample_id"], "value").collect()


def test_forests_read_few_partitions(spark, separable, monkeypatch):
    """Small tables are not cut into as many pieces as shuffles are set to: every level of every forest runs a task for each."""
    seen = []

    class Search(embedded.CrossValidator):
        def _fit(self, dataset):
            seen.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    monkeypatch.setattr(embedded, "CrossValidator", Search)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        benchmark.random_forest(trees=(2,), depths=(2,)).select(separable)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
