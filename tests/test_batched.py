"""Batched fits against one fit at a time in numpy."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from widesift.operators import batched, embedded, forward


def rows_of(spark, groups, n, width, classes, seed=0, folds=2):
    """Samples whose classes differ in the first few columns, as (cohort, seed, sample_id, label, fold, features), and as numpy by group."""
    rng = np.random.default_rng(seed)
    rows, known = [], {}
    for g in range(groups):
        y = rng.integers(0, classes, n)
        x = rng.standard_normal((n, width)) + 0.8 * (np.arange(width) < 3) * y[:, None] * np.array([1, -1, 0.5] + [0] * (width - 3))[None, :width]
        x = (x - x.mean(0)) / x.std(0)
        fold = rng.integers(0, folds, n)
        names = [f"s{i:04d}" for i in range(n)]
        rows += [(f"C{g}", 42, names[i], f"L{y[i]}", int(fold[i]), Vectors.dense(x[i])) for i in range(n)]
        known[f"C{g}", 42] = x, y, fold
    return spark.createDataFrame(rows, ["cohort", "seed", "sample_id", "label", "fold", "features"]).withColumn("seed", F.col("seed").cast("int")).repartition(5), known


def objective(x, y, w, l2, l1, k):
    logits = x @ w[:, 1:].T + w[:, 0]
    top = logits.max(1)
    loss = (np.log(np.exp(logits - top[:, None]).sum(1)) + top - logits[np.arange(len(y)), y]).sum()
    return loss + l2 / 2 * (w[:, 1:] ** 2).sum() + l1 * np.abs(w[:, 1:]).sum()


def gradient(x, y, w):
    logits = x @ w[:, 1:].T + w[:, 0]
    p = np.exp(logits - logits.max(1)[:, None])
    p /= p.sum(1)[:, None]
    p[np.arange(len(y)), y] -= 1
    return np.c_[p.sum(0), p.T @ x]


def slow_fit(x, y, k, l2=0.0, l1=0.0, rounds=20_000):
    """Accelerated proximal gradient steps over all columns."""
    z = np.c_[np.ones(len(x)), x]
    step = 1 / (0.5 * np.linalg.norm(z, 2) ** 2 + l2)
    w = v = np.zeros((k, x.shape[1] + 1))
    t = 1.0
    for _ in range(rounds):
        g = gradient(x, y, v)
        g[:, 1:] += l2 * v[:, 1:]
        new = v - step * g
        new[:, 1:] = np.sign(new[:, 1:]) * np.maximum(np.abs(new[:, 1:]) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        if ((v - new) * (new - w)).sum() < 0:  # overshot: begin again with the acceleration
            t_new, v = 1.0, new
        if np.abs(new - w).max() < 1e-11:
            return new
        w, t = new, t_new
    return w


def dense(row, width, k):
    w = np.zeros((k, width + 1))
    part = np.array(row.weights).reshape(k, -1)
    w[:, 0] = part[:, 0]
    w[:, [c + 1 for c in row.columns]] = part[:, 1:]
    return w


@pytest.mark.parametrize("cells", [1 << 21, 300])
def test_l2_fits_of_some_columns(spark, cells):
    """Every fit equals its own one, however rows are cut into blocks."""
    rows, known = rows_of(spark, 2, 120, 6, 3)
    blocks = batched.row_blocks(rows, cells)
    wanted = [(c, 42, i, held, columns, 1.0, [0.0]) for c in ("C0", "C1") for i, (held, columns) in enumerate([(-1, [0, 1, 2, 3, 4, 5]), (0, [2]), (1, [0, 5]), (0, [])])]
    fits = spark.createDataFrame(wanted, "cohort string, seed int, fit bigint, held int, columns array<int>, l2 double, strengths array<double>")
    found = batched.models(batched.fitted(blocks, batched.starting(fits, batched.class_counts(blocks, [-1, 0, 1])))).collect()
    assert len(found) == len(wanted) and all(r.converged for r in found)
    for r in found:
        x, y, fold = known[r.cohort, r.seed]
        keep = fold != r.held
        want = slow_fit(x[keep][:, list(r.columns)], y[keep], 3, l2=1.0)
        got = np.array(r.weights).reshape(3, -1)
        got[:, 0] -= got[:, 0].mean()
        want[:, 0] -= want[:, 0].mean()
        assert np.abs(got - want).max() < 1e-6


def test_a_minimum_of_many_rows_is_as_near_as_one_of_few():
    """The loss of 200 copies of every row is 200 times larger, which must not end a fit that much further from its minimum."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 150)
    x = rng.standard_normal((150, 12)) + 0.5 * np.eye(4, 12)[y]
    for l1, l2 in ((10.0, 0.0), (0.0, 1.0)):
        state = dict(present=[True] * 4, columns=list(range(12)), strengths=[l1], l2=l2, at=None, best=None, move=None, step=1.0, goal=float("inf"),
                     rounds=0, done=False, path=[])
        while not state["done"]:
            weights = np.zeros((4, 13)) if state["at"] is None else np.array(state["at"]).reshape(4, 13)
            loss, *parts = batched.sums(x, y, state["columns"], weights, np.ones(4, bool))
            state = batched.advanced(state, 200 * loss, *(200 * p for p in parts))
        w = np.array(state["path"][0]["weights"]).reshape(4, 13)
        g = 200 * gradient(x, y, w)
        g[:, 1:] += l2 * w[:, 1:]
        strength = np.c_[np.zeros(4), np.full((4, 12), l1)]
        off = np.where(w != 0, np.abs(g + strength * np.sign(w)), np.maximum(np.abs(g) - strength, 0))
        assert state["path"][0]["converged"] and off.max() < 1e-5 * max(l1, 1.0)


def test_sums_of_a_block_take_bounded_memory():
    """The products of rows, classes and columns are many times the block; they are made in slices."""
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((20_000, 30)), rng.integers(0, 8, 20_000)
    weights = rng.standard_normal((8, 31))
    tracemalloc.start()
    loss, slope, hessian, every = batched.sums(x, y, list(range(30)), weights, np.ones(8, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all products at once: 20,000 * 8 * 31 * 8 bytes = 40 MB, and copies of them
    assert np.allclose(slope, gradient(x, y, weights)) and np.allclose(every, slope[:, 1:])
    assert loss == pytest.approx(objective(x, y, weights, 0.0, 0.0, 8))
    nudge = 1e-5 * rng.standard_normal((8, 31))
    assert np.allclose(hessian @ nudge.ravel(), (gradient(x, y, weights + nudge) - gradient(x, y, weights - nudge)).ravel() / 2, rtol=1e-4, atol=1e-4)


def test_l1_path_equals_unscreened_fits(spark):
    rows, known = rows_of(spark, 2, 100, 20, 3, seed=1)
    blocks = batched.row_blocks(rows)
    strengths = [float("inf"), 20.0, 8.0, 2.0, 0.5]
    wanted = [(c, 42, i, held, [], 0.0, strengths) for c in ("C0", "C1") for i, held in enumerate((-1, 1))]
    fits = spark.createDataFrame(wanted, "cohort string, seed int, fit bigint, held int, columns array<int>, l2 double, strengths array<double>")
    states = batched.fitted(blocks, batched.starting(fits, batched.class_counts(blocks, [-1, 1])), whole=True)
    found = batched.models(states).collect()
    assert len(found) == 4 * 4 and all(r.converged for r in found)
    for r in found:
        x, y, fold = known[r.cohort, r.seed]
        keep = fold != r.held
        x, y = x[keep], y[keep]
        w = dense(r, 20, 3)
        # the optimality condition over every column, those that were screened out too
        g = gradient(x, y, w)[:, 1:]
        used = w[:, 1:] != 0
        assert np.abs(g[used] + r.strength * np.sign(w[:, 1:][used])).max(initial=0) < 1e-4
        assert np.abs(g[~used]).max() <= r.strength + 1e-4
        want = slow_fit(x, y, 3, l1=r.strength)
        assert objective(x, y, w, 0, r.strength, 3) <= objective(x, y, want, 0, r.strength, 3) + 1e-6
        assert ((np.abs(want[:, 1:]) > 1e-5) == (np.abs(w[:, 1:]) > 1e-5)).all()
    # screening: the strongest penalty was fitted over few of the columns
    assert min(len(r.columns) for r in found if r.place == 0) < 20


def test_a_class_of_one_fold_only(spark):
    """A class that only the held-out rows have gets no probability; a single class is always predicted."""
    rows = [("C", 42, f"s{i}", lab, fold, Vectors.dense([v, 1.0 * i])) for i, (lab, fold, v) in enumerate(
        [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, -1.0), ("b", 1, -2.0), ("c", 0, 9.0)])]
    frame = spark.createDataFrame(rows, ["cohort", "seed", "sample_id", "label", "fold", "features"]).withColumn("seed", F.col("seed").cast("int"))
    blocks = batched.row_blocks(frame)
    fits = spark.createDataFrame([("C", 42, 0, 0, [0], 1.0, [0.0]), ("C", 42, 1, 1, [0], 1.0, [0.0])],
                                 "cohort string, seed int, fit bigint, held int, columns array<int>, l2 double, strengths array<double>")
    found = batched.models(batched.fitted(blocks, batched.starting(fits, batched.class_counts(blocks, [0, 1]))))
    got = {(r.fit, r.label, r.prediction): r.n for r in batched.confusions(blocks, found).collect()}
    assert got == {(0, "a", "a"): 1, (0, "b", "b"): 1, (0, "c", "a"): 1, (1, "a", "a"): 1, (1, "b", "b"): 1}


def macro_f1(y, p):
    found = []
    for c in set(y) | set(p):
        tp = int(((y == c) & (p == c)).sum())
        found.append(2 * tp / ((y == c).sum() + (p == c).sum()))
    return sum(found) / len(found)


def slow_forward(x, y, fold, k, steps):
    """A model for each candidate and fold, one after another; the first of equal candidates."""
    chosen, scores = [], []
    for _ in range(steps):
        best = None
        for j in range(x.shape[1]):
            if j in chosen:
                continue
            score = 0.0
            for f in (0, 1):
                columns = [*chosen, j]
                w = slow_fit(x[fold != f][:, columns], y[fold != f], k, l2=1.0)
                guess = (x[fold == f][:, columns] @ w[:, 1:].T + w[:, 0]).argmax(1)
                score += macro_f1(y[fold == f], guess) / 2
            if best is None or round(score, 9) > round(best[1], 9):
                best = j, score
        chosen.append(best[0])
        scores.append(best[1])
    return chosen, scores


def test_forward_selection_equals_one_fit_at_a_time(spark):
    rows, known = rows_of(spark, 2, 90, 6, 3, seed=4)
    candidates = spark.createDataFrame([(f"C{g}", 42, f"f{j}") for g in range(2) for j in range(6)], "cohort string, seed int, feature string")
    found = forward.forward_selection_logistic(rows.drop("label", "fold"), rows.drop("features"), candidates, 3).collect()
    for (cohort, _), (x, y, fold) in known.items():
        mine = sorted((r for r in found if r.cohort == cohort), key=lambda r: r["rank"])
        chosen, scores = slow_forward(x, y, fold, 3, 3)
        assert [r.feature for r in mine] == [f"f{j}" for j in chosen]
        assert [r.score for r in mine] == pytest.approx(scores)


def test_forward_selection_needs_no_more_jobs_for_more_candidates(spark):
    """The rounds follow the slowest fit; four times the candidates do not make four times the jobs."""
    def jobs(width):
        rows, _ = rows_of(spark, 1, 60, width, 2, seed=5)
        candidates = spark.createDataFrame([("C0", 42, f"f{j:02d}") for j in range(width)], "cohort string, seed int, feature string")
        group = f"forward-{width}"
        spark.sparkContext.setJobGroup(group, group)
        forward.forward_selection_logistic(rows.drop("label", "fold"), rows.drop("features"), candidates, 1).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs(20) < 2 * jobs(5)


def test_lasso_scores_take_the_strongest_of_equal_strengths(spark):
    rows, known = rows_of(spark, 1, 120, 8, 3, seed=6)
    vectors = rows.drop("fold").withColumn("part", F.lit("train"))
    places = spark.createDataFrame([("C0", 42, f"f{j}", j) for j in range(8)], "cohort string, seed int, feature string, pos int")
    found = {r.feature: r.score for r in embedded.lasso_scores(vectors, places, (1e-4, 1e-2, 1.0, 1e2), 3).collect()}
    assert len(found) == 8 and {"f0", "f1"} <= {f for f, s in found.items() if s > 0}
    x, y, _ = known["C0", 42]
    want = [np.abs(slow_fit(x, y, 3, l1=1 / c)[:, 1:]).max(0) for c in (1e-4, 1e-2, 1.0, 1e2)]
    got = np.array([found[f"f{j}"] for j in range(8)])
    assert min(np.abs(got - w).max() for w in want) < 1e-3


def test_fits_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    """A lost driver leaves whole rounds behind; the next call repeats none of them and ends with the same weights."""
    rows, _ = rows_of(spark, 1, 60, 5, 3, seed=7)
    blocks = batched.row_blocks(rows)
    fits = spark.createDataFrame([("C0", 42, 0, -1, [0, 1, 2, 3, 4], 0.1, [0.0])],
                                 "cohort string, seed int, fit bigint, held int, columns array<int>, l2 double, strengths array<double>")
    states = batched.starting(fits, batched.class_counts(blocks, [-1]))
    whole = batched.models(batched.fitted(blocks, states)).first()
    folder, rounds, real = str(tmp_path / "fits"), [], batched.written

    def stopping(frame, to):
        if len(rounds) == 3:
            raise KeyboardInterrupt
        rounds.append(to)
        return real(frame, to)

    monkeypatch.setattr(batched, "written", stopping)
    with pytest.raises(KeyboardInterrupt):
        batched.fitted(blocks, states, folder=folder)
    first = [r.rsplit("/", 1)[1] for r in rounds]
    monkeypatch.setattr(batched, "written", lambda frame, to: (rounds.append(to), real(frame, to))[1])
    again = batched.models(batched.fitted(blocks, states, folder=folder)).first()
    assert list(again.weights) == list(whole.weights)
    second = [r.rsplit("/", 1)[1] for r in rounds[3:]]
    assert first == ["000000", "000001", "000002"] and second[0] == "000003" and not set(first) & set(second)
