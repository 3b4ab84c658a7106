import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from widesift.functions import columns
from widesift.operators import (align, forward, information, metrics, moments, prepare, ranking, scores, selection,
                                splits)

SEEDS = [1, 2]
MATRIX = "cohort string, sample_id string, feature string, value double"
SAMPLES = "cohort string, sample_id string, label string"


def dense(spark, n=60, features=5, classes=3, seed=0, shift=0.0, ties=False):
    rng = random.Random(seed)
    labels = {f"s{i:03d}": f"c{i % classes}" for i in range(n)}
    cells = []
    for s, c in labels.items():
        for f in range(features):
            x = rng.gauss(0, 1) + shift * (int(c[1:]) == f)
            cells.append(("X", s, f"f{f}", float(round(x)) if ties else x))
    return (spark.createDataFrame(cells, MATRIX),
            spark.createDataFrame([("X", s, c) for s, c in labels.items()], SAMPLES))


# ---- splits -----------------------------------------------------------------------------------

def test_split_shares_and_lone_classes(spark):
    sizes = {"a": 31, "b": 17, "c": 4, "d": 1, "e": 1}
    rows = [("X", f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    split = splits.stratified_split(spark.createDataFrame(rows, SAMPLES), SEEDS).collect()
    n = sum(sizes.values())
    for seed in SEEDS:
        mine = [r for r in split if r["seed"] == seed]
        assert len(mine) == len({r["sample_id"] for r in mine}) == n
        assert sum(r["part"] == "test" for r in mine) == math.ceil(0.3 * n)
        assert all(r["part"] == "train" for r in mine if r["label"] in "de")
        for c in "abc":
            got = sum(r["part"] == "train" for r in mine if r["label"] == c)
            assert abs(got - 0.7 * sizes[c]) <= 1
    assert {r["sample_id"] for r in split if r["seed"] == 1 and r["part"] == "test"} != {
        r["sample_id"] for r in split if r["seed"] == 2 and r["part"] == "test"}


def test_folds_are_balanced(spark):
    _, samples = dense(spark, n=61)
    folds = splits.stratified_folds(samples.withColumn("seed", F.lit(1)), 3)
    for row in folds.groupBy("label").pivot("fold").count().collect():
        counts = [row[str(k)] for k in range(3)]
        assert max(counts) - min(counts) <= 1


def test_split_does_not_depend_on_partitioning(spark):
    _, samples = dense(spark, n=80)
    results = []
    for partitions in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(map(tuple, splits.stratified_split(samples.repartition(int(partitions)), SEEDS).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_seed_helpers(spark):
    assert splits.consecutive_seeds(42, 3) == [42, 43, 44]
    assert splits.random_seeds(42, 3) == splits.random_seeds(42, 5)[:3] and len(set(splits.random_seeds(42, 5))) == 5
    assert [tuple(r) for r in splits.seed_table(spark, 42, 2).orderBy("run_id").collect()] == [(0, 42), (1, 43)]


# ---- ranking ----------------------------------------------------------------------------------

@pytest.mark.parametrize("buckets", [1, 2, 5])
def test_medians_equal_numpy(spark, buckets):
    rng = random.Random(3)
    groups = {"a": [rng.choice([0.0, 0.0, 0.0, 1.5, rng.random()]) for _ in range(101)], "b": [rng.random() for _ in range(40)], "c": [2.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("d", None)]
    got = ranking.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m", buckets)
    assert {r["g"]: r["m"] for r in got.collect()} == pytest.approx({g: float(np.median(v)) for g, v in groups.items()})


@pytest.mark.parametrize("buckets", [2, 7])
def test_running_total_in_buckets_equals_one_window(spark, buckets):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 30) / 1.0, i) for i in range(300)], "g string, x double, i int")
    plain = ranking.running_total(df, ["g"], ["x", "i"], F.col("i"), "t")
    cut = ranking.running_total(ranking.with_value_bucket(df, ["g"], "x", buckets), ["g"], ["x", "i"], F.col("i"), "t", bucketed=True)
    assert sorted(map(tuple, plain.select("g", "x", "i", "t").collect())) == sorted(map(tuple, cut.select("g", "x", "i", "t").collect()))


# ---- moments and scores -----------------------------------------------------------------------

def anova_by_hand(values, labels):
    groups = [[v for v, c in zip(values, labels) if c == k] for k in sorted(set(labels))]
    n, k, mean = len(values), len(groups), np.mean(values)
    between = sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups) / (k - 1)
    return between / (sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups) / (n - k))


def test_scores_equal_numpy_and_ignore_test_rows(spark):
    matrix, samples = dense(spark, shift=1.0)
    split = splits.stratified_split(samples, SEEDS)
    summary = moments.feature_moments(moments.feature_stats(matrix, split, SEEDS, samples))
    f = {(r["seed"], r["feature"]): r["score"] for r in scores.anova_scores(summary).collect()}
    v = {(r["seed"], r["feature"]): r["score"] for r in scores.variance_scores(summary).collect()}
    cells = prepare.train_cells(matrix, split).toPandas()
    for (seed, feature), rows in cells.groupby(["seed", "feature"]):
        assert f[seed, feature] == pytest.approx(anova_by_hand(list(rows["value"]), list(rows["label"])))
        assert v[seed, feature] == pytest.approx(np.var(rows["value"]))
    test_ids = split.where("part = 'test' AND seed = 1").select("cohort", "sample_id", F.lit(99.0).alias("bump"))
    spoiled = matrix.join(test_ids, ["cohort", "sample_id"], "left").withColumn("value", F.col("value") + F.coalesce("bump", F.lit(0.0))).drop("bump")
    again = scores.anova_scores(moments.feature_moments(moments.feature_stats(spoiled, split, [1], samples)))
    assert {r["feature"]: r["score"] for r in again.collect()} == pytest.approx({k[1]: s for k, s in f.items() if k[0] == 1})


def test_many_seeds_are_split_into_passes(spark):
    matrix, samples = dense(spark, n=30, features=2)
    seeds = list(range(40))
    split = splits.stratified_split(samples, seeds)
    stats = moments.feature_stats(matrix, split, seeds, samples)
    assert stats.select("seed").distinct().count() == 40
    one = moments.feature_stats(matrix, split, [37], samples)
    key = ["feature", "label", "n", "mean"]
    assert sorted(map(tuple, stats.where("seed = 37").select(*key).collect())) == sorted(map(tuple, one.select(*key).collect()))


def test_sparse_moments_equal_dense_moments(spark):
    rng = random.Random(5)
    labels = {f"s{i}": f"c{i % 4}" for i in range(48)}
    cells = [("X", s, f"f{f}", rng.choice([0.0, 0.0, 0.0, 1.0, 2.5]) if f < 4 else 1.0 if f == 4 else 0.0) for s in labels for f in range(6)]
    samples = spark.createDataFrame([("X", s, c) for s, c in labels.items()], SAMPLES)
    full = spark.createDataFrame(cells, MATRIX)
    split = splits.stratified_split(samples, SEEDS)
    whole = moments.feature_moments(moments.feature_stats(full, split, SEEDS, samples))
    thin = moments.feature_moments(moments.feature_stats(full.where("value <> 0"), split, SEEDS, samples), moments.class_sizes(split))
    columns_ = ["n", "k", "mean", "between", "within", "lo", "hi"]
    a = {(r["seed"], r["feature"]): [float(r[c]) for c in columns_] for r in whole.collect() if r["feature"] != "f5"}
    b = {(r["seed"], r["feature"]): [float(r[c]) for c in columns_] for r in thin.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-9)
    assert not {r["feature"] for r in scores.varying_features(thin).collect()} & {"f4", "f5"}


def test_anova_edge_cases(spark):
    rows = [("X", f"s{i}", f, v) for i in range(6) for f, v in (("apart", float(i // 3)), ("flat", 2.0), ("mixed", float(i)))]
    samples = spark.createDataFrame([("X", f"s{i}", "ab"[i // 3]) for i in range(6)], SAMPLES)
    split = samples.withColumn("seed", F.lit(1)).withColumn("part", F.lit("train"))
    summary = moments.feature_moments(moments.feature_stats(spark.createDataFrame(rows, MATRIX), split, [1], samples))
    got = scores.anova_scores(summary)
    by = {r["feature"]: r["score"] for r in got.collect()}
    assert by["apart"] == float("inf") and by["flat"] is None and by["mixed"] == pytest.approx(13.5)
    assert [r["feature"] for r in selection.ranked_scores(got).orderBy("rank").collect()] == ["apart", "mixed", "flat"]


def test_selection_modes(spark):
    table = spark.createDataFrame([("X", 1, f"f{i}", s) for i, s in enumerate([3.0, 1.0, 3.0, 0.0, None, 2.0])],
                                  "cohort string, seed int, feature string, score double")

    def names(df):
        return [r["feature"] for r in df.orderBy("rank" if "rank" in df.columns else "feature").collect()]

    assert names(selection.select_features(table, "top_k", 3)) == ["f2", "f0", "f5"]
    assert names(selection.select_features(table, "top_k", 3, buckets=3)) == ["f2", "f0", "f5"]
    assert names(selection.select_features(table, "top_k", 2, higher_index_wins=False)) == ["f0", "f2"]
    assert len(names(selection.select_features(table, "top_k", 100))) == 6
    assert names(selection.select_features(table, "fraction", 0.01)) == ["f2"]
    assert names(selection.select_features(table, "threshold", 1.0)) == ["f0", "f2", "f5"]
    assert names(selection.select_features(table, "gt_mean")) == ["f0", "f2", "f5"]
    assert names(selection.select_features(table, "nonzero")) == ["f0", "f1", "f2", "f5"]
    with pytest.raises(ValueError):
        selection.select_features(table, "other")


def test_own_scorer_goes_through_the_registry(spark):
    @scores.scorer("range")
    def spread(summary):
        return summary.select(*scores.KEYS, (F.col("hi") - F.col("lo")).alias("score"))

    matrix, samples = dense(spark)
    split = splits.stratified_split(samples, [1])
    summary = moments.feature_moments(moments.feature_stats(matrix, split, [1], samples))
    assert selection.top_k(scores.SCORERS["range"](summary), 2).count() == 2
    del scores.SCORERS["range"]


# ---- mutual information -----------------------------------------------------------------------

def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def information_by_hand(x, labels):
    size = {c: list(labels).count(c) for c in set(labels)}
    points = [(v, c) for v, c in zip(x, labels) if size[c] > 1]
    ks, ms, ns = [], [], []
    for i, (v, c) in enumerate(points):
        k = min(3, size[c] - 1)
        r = sorted(abs(v - w) for j, (w, d) in enumerate(points) if d == c and j != i)[k - 1]
        ks.append(psi(k))
        ns.append(psi(size[c]))
        ms.append(psi(sum(abs(v - w) < r for w, _ in points)))
    return max(0.0, psi(len(points)) + np.mean(ks) - np.mean(ns) - np.mean(ms))


def noise(sample_id, values):
    import hashlib
    u = int(hashlib.md5(sample_id.encode()).hexdigest()[:13], 16) / 16 ** 13
    return 1e-10 * max(1.0, float(np.mean(np.abs(values)))) * u


@pytest.mark.parametrize("buckets", [1, 4])
@pytest.mark.parametrize("ties", [False, True])
def test_mutual_information_equals_all_pairs(spark, buckets, ties):
    rng = random.Random(7)
    labels = {f"s{i}": "abcd"[min(3, i % 5)] for i in range(45)} | {"lone": "z", "p1": "y", "p2": "y"}
    cells = []
    for s, c in labels.items():
        for f in range(2):
            x = rng.gauss("abcdyz".index(c) * f, 1)
            cells.append(("X", 1, s, c, f"f{f}", float(round(x)) if ties else x))
    df = spark.createDataFrame(cells, "cohort string, seed int, sample_id string, label string, feature string, value double")
    got = {r["feature"]: r["score"] for r in information.mutual_information(df, buckets).collect()}
    for f in ("f0", "f1"):
        rows = [(s, c, v) for _, _, s, c, g, v in cells if g == f]
        values = [v for _, _, v in rows]
        x = [v + noise(s, values) for s, _, v in rows]
        assert got[f] == pytest.approx(information_by_hand(x, [c for _, c, _ in rows]), abs=1e-9)


def test_digamma(spark):
    got = spark.range(1, 200).select("id", columns.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r["p"] - psi(r["id"])) < 1e-11 for r in got)


# ---- preparation ------------------------------------------------------------------------------

def test_scaling_and_imputation(spark):
    samples = spark.createDataFrame([("X", f"s{i}", "ab"[i % 2]) for i in range(4)], SAMPLES)
    matrix = spark.createDataFrame([("X", f"s{i}", f, v) for f, values in {"gap": [1.0, None, 4.0, 9.0], "none": [None] * 4, "flat": [2.0] * 4}.items()
                                    for i, v in enumerate(values)], MATRIX)
    split = samples.withColumn("seed", F.lit(1)).withColumn("part", F.when(F.col("sample_id") == "s3", "test").otherwise("train"))
    fill = prepare.train_medians(matrix, split)
    assert {r["feature"]: r["fill"] for r in fill.collect()} == {"gap": 2.5, "flat": 2.0}
    filled = prepare.median_impute(matrix, split, fill)
    assert {r["sample_id"]: r["value"] for r in filled.where("feature = 'gap'").collect()} == {"s0": 1.0, "s1": 2.5, "s2": 4.0, "s3": 9.0}
    stats = moments.feature_stats(matrix, split, [1], samples)
    summary = moments.feature_moments(stats, moments.class_sizes(split), fill)
    by = {r["feature"]: r for r in summary.collect()}
    assert by["gap"]["mean"] == pytest.approx(2.5) and by["gap"]["n"] == 3
    assert (by["gap"]["between"] + by["gap"]["within"]) / 3 == pytest.approx(np.var([1.0, 2.5, 4.0]))
    scaled = {(r["sample_id"], r["feature"]): r["scaled"] for r in prepare.standard_scale(filled.select("cohort", "seed", "sample_id", "feature", "value"), summary).collect()}
    assert scaled["s3", "gap"] == pytest.approx((9 - 2.5) / np.std([1.0, 2.5, 4.0])) and scaled["s0", "flat"] == 0.0
    vector = prepare.assemble(filled, ["sample_id"], "value").where("sample_id = 's0'").first()["features"]
    assert list(vector) == [2.0, 1.0]


# ---- metrics ----------------------------------------------------------------------------------

PRED = "cohort string, seed int, method string, param string, sample_id string, label string, prediction string, proba map<string,double>"


def predictions(spark, rows):
    return spark.createDataFrame([("X", 1, "m", "p", f"s{i}", y, g, p) for i, (y, g, p) in enumerate(rows)], PRED)


def test_metrics_with_classes_on_one_side_only(spark):
    table = predictions(spark, [("a", "a", None), ("a", "b", None), ("b", "b", None), ("c", "d", None)])
    row = metrics.run_metrics(table).first()
    assert row["accuracy"] == row["weighted_recall"] == 0.5
    f1 = {"a": 2 / 3, "b": 2 / 3, "c": 0.0, "d": 0.0}
    assert row["macro_f1"] == pytest.approx(sum(f1.values()) / 4)
    assert row["weighted_f1"] == pytest.approx((2 * f1["a"] + f1["b"]) / 4)
    assert row["macro_recall"] == pytest.approx((0.5 + 1.0) / 4)
    confusion = metrics.confusion_matrix(table)
    assert confusion.count() == 16 and confusion.agg(F.sum("n")).first()[0] == 4
    report = {r["class"]: r for r in metrics.class_report(table).collect()}
    assert report["accuracy"]["f1"] == 0.5 and report["macro avg"]["support"] == 4


@pytest.mark.parametrize("buckets", [1, 3])
def test_auc_counts_ties_as_half(spark, buckets):
    rng = random.Random(9)
    rows = [("g", rng.random() < 0.4, rng.randint(0, 6) / 6) for _ in range(80)] + [("none", False, 0.5)]
    got = {r["g"]: r["auc"] for r in metrics.score_auc(spark.createDataFrame(rows, "g string, positive boolean, score double"), ["g"], buckets).collect()}
    pos = [s for g, y, s in rows if g == "g" and y]
    neg = [s for g, y, s in rows if g == "g" and not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["g"] == pytest.approx(wins / (len(pos) * len(neg))) and got["none"] is None


def test_auc_averages(spark):
    proba = [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 0.1, "b": 0.2, "c": 0.7}]
    full = metrics.average_auc(metrics.class_auc(predictions(spark, [(y, y, p) for y, p in zip("abac", proba)]))).first()
    assert full["roc_auc_macro"] == full["roc_auc_weighted"] == 1.0
    short = metrics.average_auc(metrics.class_auc(predictions(spark, [(y, y, p) for y, p in zip("abab", proba)]))).first()
    assert short["roc_auc_macro"] is None
    two = predictions(spark, [("a", "a", {"a": 0.4, "b": 0.6}), ("b", "b", {"a": 0.5, "b": 0.5}), ("b", "b", {"a": 0.1, "b": 0.9})])
    assert metrics.average_auc(metrics.class_auc(two)).first()["roc_auc_macro"] == 0.5


def test_probability_cleaning(spark):
    rows = [("s0", "a", float("nan")), ("s0", "b", float("-inf")), ("s1", "a", float("inf")), ("s1", "b", 0.25), ("s2", "a", None), ("s2", "b", 0.5)]
    clean = metrics.clean_probabilities(spark.createDataFrame(rows, "sample_id string, class string, p double"))
    assert {(r[0], r[1]): r[2] for r in clean.collect()} == {("s0", "a"): 0.0, ("s0", "b"): 0.0, ("s1", "a"): 1.0, ("s1", "b"): 0.25, ("s2", "a"): 0.0, ("s2", "b"): 0.5}
    unit = {(r["sample_id"], r["class"]): r["p"] for r in metrics.normalise_probabilities(clean, []).collect()}
    assert unit["s0", "a"] == 0.0 and unit["s1", "a"] == 0.8 and unit["s2", "b"] == 1.0


def test_best_class_of_scores(spark):
    rows = [("s0", "x", c, s) for c, s in (("a", 1.0), ("b", 1.0), ("c", 0.0))]
    got = metrics.predictions_from_scores(spark.createDataFrame(rows, "sample_id string, label string, class string, score double"), []).first()
    assert got["prediction"] == "a" and sum(got["proba"].values()) == pytest.approx(1.0)
    assert got["proba"]["a"] == pytest.approx(math.e / (2 * math.e + 1))


# ---- alignment and forward selection ----------------------------------------------------------

def test_duplicates_multiply_without_dedup(spark):
    matrix = spark.createDataFrame([("X", "s1", "f", 1.0), ("X", "s1", "f", 2.0), ("X", "s2", "f", 3.0)], MATRIX)
    labels = spark.createDataFrame([("X", "s1", "a"), ("X", "s1", "b"), ("X", "s3", "c")], SAMPLES)
    assert align.align(matrix, labels).count() == 4
    assert align.common_samples(matrix, labels).count() == 2
    assert [tuple(r) for r in align.matrix_shape(matrix, labels).collect()] == [("X", 2, 1, 3, 2)]


def test_shuffle_join_beyond_the_broadcast_limit(spark):
    matrix, samples = dense(spark, n=20)
    near = sorted(map(tuple, align.align(matrix, samples).collect()))
    spark.conf.set("widesift.broadcastBytes", "1")
    far = align.align(matrix, samples)
    assert "ResolvedHint" not in far._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, far.collect())) == near
    spark.conf.unset("widesift.broadcastBytes")


def test_forward_selection_takes_informative_features_first(spark):
    matrix, samples = dense(spark, n=90, features=5, classes=3, shift=4.0)
    train = splits.stratified_split(samples, [1]).where("part = 'train'").drop("part")
    folded = splits.stratified_folds(train, 2)
    found = forward.forward_selection(matrix, folded, steps=7).orderBy("rank").collect()
    assert {r["feature"] for r in found[:2]} <= {"f0", "f1", "f2"} and len(found) == 5
    assert found[1]["score"] > found[0]["score"]


def test_forward_selection_whatever_the_unit(spark):
    """Features chosen by their spread alone, so that an absolute smoothing hides them in small units."""
    rng = random.Random(3)
    cells = [("X", f"s{i:03d}", f"f{f}", rng.gauss(0, 1 + 9 * (i % 3 == f))) for i in range(150) for f in range(4)]
    cells += [("X", f"s{i:03d}", "flat", 1.0) for i in range(150)]
    samples = spark.createDataFrame([("X", f"s{i:03d}", f"c{i % 3}") for i in range(150)], SAMPLES)
    folded = splits.stratified_folds(splits.stratified_split(samples, [1]).where("part = 'train'").drop("part"), 2)
    found = [[(r["feature"], round(r["score"], 6)) for r in forward.forward_selection(
        spark.createDataFrame([(*c[:3], c[3] * unit) for c in cells], MATRIX), folded, steps=3).orderBy("rank").collect()] for unit in (1.0, 1e-7)]
    assert found[0] == found[1] and found[0][1][1] > 0.5
    one = spark.createDataFrame([c for c in cells if c[2] == "flat"], MATRIX)
    assert forward.forward_selection(one, folded, steps=1).count() == 1


def test_small_scores_keep_their_order_and_infinite_ones_their_place(spark):
    rows = [("X", 1, n, v) for n, v in (("a", 1e-10), ("b", 3e-10), ("z", 1e-12), ("none", None))]
    table = spark.createDataFrame(rows, "cohort string, seed int, feature string, score double")
    for buckets in (1, 4):
        assert [r["feature"] for r in selection.top_k(table, 2, buckets=buckets).orderBy("rank").collect()] == ["b", "a"]
    more = table.unionByName(spark.createDataFrame([("X", 1, "inf", float("inf"))], table.schema))
    assert {r["feature"] for r in selection.above_mean(more).collect()} == {"inf", "b"}


def test_top_k_among_many_ties_equals_the_plain_ranking(spark):
    rng = random.Random(4)
    rows = [("X", s, f"f{i:04d}", rng.choice([0.0] * 9 + [rng.random()])) for s in (1, 2) for i in range(900)]
    table = spark.createDataFrame(rows, "cohort string, seed int, feature string, score double").repartition(5)
    for k in (1, 50, 400, 2000):
        plain, cut = ({(r["seed"], r["feature"], r["rank"]) for r in selection.top_k(table, k, buckets=b).collect()} for b in (1, 8))
        assert plain == cut and len(plain) == 2 * min(k, 900)


def test_medians_of_mostly_equal_values(spark):
    rng = random.Random(5)
    rows = [(g, 0.0 if rng.random() < 0.9 else rng.gauss(0, 1)) for g in "ab" for _ in range(501 if g == "a" else 500)] + [("c", 2.0), ("c", 3.0), ("d", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(6)
    want = {g: float(np.median([v for h, v in rows if h == g])) for g in "abc"}
    for buckets in (1, 16):
        assert {r["g"]: r["m"] for r in ranking.medians(table, ["g"], "v", "m", buckets).collect()} == pytest.approx(want)


def test_saturated_areas_and_shifted_moments(spark):
    rows = [("k", True, 1e-11), ("k", True, 1e-12), ("k", False, 1e-14), ("k", False, 1e-15)]
    assert metrics.score_auc(spark.createDataFrame(rows, "k string, positive boolean, score double"), ["k"]).first()["auc"] == 1.0
    cells = [("X", f"s{i}", "f", 1e8 + (i % 2) + 0.01 * (i % 3)) for i in range(20)]
    split = spark.createDataFrame([("X", 1, f"s{i}", str(i % 2), "train") for i in range(20)], "cohort string, seed int, sample_id string, label string, part string")
    stats = moments.feature_stats(spark.createDataFrame(cells, "cohort string, sample_id string, feature string, value double"), split, [1], split)
    plain, filled = (moments.feature_moments(stats, sizes).first()["between"] for sizes in (None, moments.class_sizes(split)))
    assert filled == pytest.approx(plain, rel=1e-6) and filled > 4



def _forward_by_hand(cells, folded, steps):
    """The selection by loops over (sample, feature, value or None) cells and (sample, label, fold) rows of one group."""
    features, classes = sorted({f for _, f, _ in cells}), sorted({c for _, c, _ in folded})
    value = {(s, f): v for s, f, v in cells}
    fits = {}
    for fold in (0, 1):
        fitting = [(s, c) for s, c, k in folded if k != fold]
        known = {(f, c): [value[s, f] for s, k in fitting if k == c and value.get((s, f)) is not None] for f in features for c in classes}
        added = 1e-9 * max(np.var(sum((known[f, c] for c in classes), [])) for f in features)
        for f in features:
            for c in classes:
                fits[fold, f, c] = (np.mean(known[f, c]), np.var(known[f, c]) + added) if known[f, c] else None
        fits[fold] = {c: math.log(sum(k == c for _, k in fitting) / len(fitting)) for c in classes}

    def term(s, f, c, fold):
        if value.get((s, f)) is None or fits[fold, f, c] is None:
            return 0.0
        mean, var = fits[fold, f, c]
        return -0.5 * math.log(2 * math.pi * var) - (value[s, f] - mean) ** 2 / (2 * var)

    chosen = []
    for _ in range(steps):
        scored = []
        for f in [f for f in features if f not in [c for c, _ in chosen]]:
            by_fold = []
            for fold in (0, 1):
                pairs = []
                for s, label, k in folded:
                    if k == fold and (s, f) in value:
                        sums = [round(fits[fold][c] + sum(term(s, g, c, fold) for g, _ in chosen) + term(s, f, c, fold), 9) for c in classes]
                        pairs.append((label, classes[sums.index(max(sums))]))
                seen = {c for p in pairs for c in p}
                by_fold.append(np.mean([2 * sum(a == b == c for a, b in pairs) / sum((a == c) + (b == c) for a, b in pairs) for c in seen]))
            scored.append((-round(np.mean(by_fold), 9), f))
        chosen.append((min(scored)[1], -min(scored)[0]))
    return chosen


@pytest.mark.parametrize("cells_per_block", [1 << 20, 40])
def test_forward_selection_with_gaps_in_blocks(spark, cells_per_block):
    """Absent and null cells count as before, and results do not depend on the blocks that the rows lie in."""
    rng = random.Random(8)
    folded, cells = [], []
    for i in range(60):
        c = i % 3
        folded.append((f"s{i:02d}", f"c{c}", rng.randrange(2)))
        for f in range(5):
            if rng.random() < 0.85:
                cells.append((f"s{i:02d}", f"f{f}", None if rng.random() < 0.1 else rng.gauss(0, 1) + (c == f) * 1.5))
    cells = [x for x in cells if not (x[1] == "f4" and int(x[0][1:]) % 3 == 2)]  # a class without cells
    matrix = spark.createDataFrame([("A", *x) for x in cells], "cohort string, sample_id string, feature string, value double")
    rows = spark.createDataFrame([("A", 1, *x) for x in folded], "cohort string, seed int, sample_id string, label string, fold int")
    found = forward.forward_selection(matrix, rows, steps=4, cells_per_block=cells_per_block).orderBy("rank").collect()
    assert [(r["feature"], pytest.approx(r["score"], abs=1e-9)) for r in found] == _forward_by_hand(cells, folded, 4)


def test_training_cells_are_dealt_by_their_number(spark, monkeypatch):
    """A task gets a few features of one seed, however well a shuffle compresses them."""
    monkeypatch.setattr(prepare, "CELLS_PER_TASK", 40, raising=False)
    matrix, samples = dense(spark, features=12)
    cells = prepare.train_cells(matrix, splits.stratified_split(samples, SEEDS))
    by_task = cells.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in by_task) == 2 * 12 * 42
    assert max(r["count"] for r in by_task) <= 8 * 42
    one_task = cells.select(*prepare.KEYS, F.spark_partition_id().alias("p")).distinct()
    assert one_task.count() == 2 * 12


def test_positions_of_many_features_are_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prepare, "FEATURES_PER_TASK", 30, raising=False)
    rng = random.Random(6)
    rows = [(g, f"w{rng.randrange(10 ** 6)}") for g in "ab" for _ in range(200)] + [("c", "w1")]
    found = prepare.positions(spark.createDataFrame(rows + rows, "cohort string, feature string"), ["cohort"])
    want = {(g, f): (i, len(of)) for g in "abc" for of in [sorted({f for c, f in rows if c == g})] for i, f in enumerate(of)}
    assert {(r["cohort"], r["feature"]): (r["pos"], r["width"]) for r in found.collect()} == want


def test_no_window_orders_a_whole_vocabulary(spark, monkeypatch):
    """The largest group that a window puts in order is a range of the features, not all of them."""
    monkeypatch.setattr(prepare, "FEATURES_PER_TASK", 30, raising=False)
    groups = []
    plain = ranking.numbered

    def numbered(df, keys, *rest, **options):
        groups.extend(r["count"] for r in df.groupBy(*keys, ranking.BUCKET).count().collect())
        return plain(df, keys, *rest, **options)

    monkeypatch.setattr(ranking, "numbered", numbered)
    prepare.positions(spark.createDataFrame([("a", f"w{i}") for i in range(300)], "cohort string, feature string"), ["cohort"]).collect()
    assert groups and sum(groups) == 300 and max(groups) <= 100
