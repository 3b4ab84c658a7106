"""Stochastic one-vs-rest models against a plain loop."""

import time
import zlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from widesift.operators import batched, stochastic


def vectors_of(spark, n=80, width=4, classes=3, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.standard_normal((n, width)) + 2.0 * (np.arange(width) == y[:, None])
    rows = [("C", 7, "m", "p", f"s{i:03d}", f"L{y[i]}", "train" if i % 4 else "test", Vectors.dense(x[i])) for i in range(n)]
    kinds = ["cohort", "seed", "method", "param", "sample_id", "label", "part", "features"]
    frame = spark.createDataFrame(rows, kinds).withColumn("seed", F.col("seed").cast("int")).repartition(parts)
    return frame, x, y, np.array([bool(i % 4) for i in range(n)])


def slow_pass(x, y, names, w, scale, done, penalty=1e-4):
    """Row by row and class by class."""
    w = w.copy()
    offset = 1 / (penalty ** -0.25 * penalty)
    for t, i in enumerate(sorted(range(len(y)), key=lambda i: (zlib.crc32(f"7:{names[i]}".encode()), names[i])), done + 1):
        step = scale / (penalty * (offset + t))
        for c in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(w[c, 0] + w[c, 1:] @ x[i], -500, 500)))
            w[c, 1:] = w[c, 1:] * max(0, 1 - step * penalty) - step * (p - (y[i] == c)) * x[i]
            w[c, 0] -= step * (p - (y[i] == c))
    return w


def test_a_pass_equals_a_plain_loop(spark):
    frame, x, y, train = vectors_of(spark)
    names = [f"s{i:03d}" for i in np.flatnonzero(train)]
    w = np.random.default_rng(1).standard_normal((3, 5))
    order = np.array(sorted(range(len(names)), key=lambda i: (zlib.crc32(f"7:{names[i]}".encode()), names[i])))
    got = stochastic.one_pass(x[train], y[train], order, w, 1e-4, 0.25, 60)
    assert np.allclose(got, slow_pass(x[train], y[train], names, w, 0.25, 60))


def test_turns_follow_hash_and_name():
    ids = sorted(f"s{i}" for i in range(500))
    assert stochastic.turns(7, ids).tolist() == sorted(range(500), key=lambda i: (zlib.crc32(f"7:{ids[i]}".encode()), ids[i]))


def test_a_row_takes_few_calls():
    """What a row costs is its calls of numpy, not its numbers; a pass is nearly all of a fit's time."""
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((4000, 64)), rng.integers(0, 10, 4000).astype(np.int32)
    weights, order = np.zeros((10, 65)), rng.permutation(4000)

    def plain(w):
        hot = np.eye(10)
        for t, i in enumerate(order, 1):
            step = 1.0 / (1e-4 * (1000 + t))
            off = 1.0 / (1.0 + np.exp(-np.clip(w[:, 1:] @ x[i] + w[:, 0], -500, 500))) - hot[y[i]]
            w[:, 1:] *= max(0.0, 1.0 - step * 1e-4)
            w[:, 1:] -= np.outer(step * off, x[i])
            w[:, 0] -= step * off

    def least(run):
        spent = []
        for _ in range(3):
            begun = time.perf_counter()
            run()
            spent.append(time.perf_counter() - begun)
        return min(spent)

    assert least(lambda: stochastic.one_pass(x, y, order, weights, 1e-4, 1.0, 0)) < 0.75 * least(lambda: plain(weights.copy()))


def test_losses_fall_and_partitions_do_not_matter(spark):
    settings = stochastic.Settings(passes=6, tolerance=None)
    found = []
    for parts in (1, 7):
        frame, x, y, train = vectors_of(spark, parts=parts)
        blocks = batched.row_blocks(frame.where("part = 'train'").drop("part"), 150, stochastic.RUN_KEYS)
        assert blocks.count() > 1
        [state] = stochastic.fitted(blocks, settings).collect()
        assert state.passes == 6 and len(state.losses) == 7
        assert all(b <= a for a, b in zip(state.losses, state.losses[1:]))
        found.append(list(state.best))
    assert found[0] == found[1]


def test_runs_end_where_the_loss_stands_still(spark):
    frame, x, y, train = vectors_of(spark)
    predictions, states = stochastic.fit_runs(frame, stochastic.Settings(passes=1000, tolerance=1e-3))
    [state] = states.collect()
    assert state.done and state.passes < 1000 and state.losses[-6] - state.losses[-1] < 5e-3
    rows = predictions.collect()
    assert len(rows) == 20 and np.mean([r.label == r.prediction for r in rows]) > 0.7
    for r in rows:
        assert sum(r.proba.values()) == pytest.approx(1.0) and r.proba[r.prediction] == max(r.proba.values())


def test_passes_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    frame, *_ = vectors_of(spark)
    blocks, settings = stochastic.run_blocks(frame, "train"), stochastic.Settings(passes=4, tolerance=None)
    [whole] = stochastic.fitted(blocks, settings).collect()
    rounds, real = [], stochastic.written

    def stopping(rows, to):
        if len(rounds) == 3:
            raise KeyboardInterrupt
        rounds.append(to)
        return real(rows, to)

    monkeypatch.setattr(stochastic, "written", stopping)
    with pytest.raises(KeyboardInterrupt):
        stochastic.fitted(blocks, settings, str(tmp_path / "passes"))
    monkeypatch.setattr(stochastic, "written", lambda rows, to: (rounds.append(to), real(rows, to))[1])
    [again] = stochastic.fitted(blocks, settings, str(tmp_path / "passes")).collect()
    assert (list(again.best), list(again.losses)) == (list(whole.best), list(whole.losses)) and len(rounds) == len(set(rounds))


def test_a_class_of_test_rows_only(spark):
    rows = [("C", 7, "m", "p", f"s{i}", "ab"[i % 2], "train", Vectors.dense([float(i % 2) - 0.5])) for i in range(8)] + [("C", 7, "m", "p", "t", "z", "test", Vectors.dense([0.5]))]
    frame = spark.createDataFrame(rows, ["cohort", "seed", "method", "param", "sample_id", "label", "part", "features"]).withColumn("seed", F.col("seed").cast("int"))
    [row] = stochastic.fit_runs(frame, stochastic.Settings(passes=3, tolerance=None, softmax=True))[0].collect()
    assert (row.label, row.prediction) == ("z", "b") and set(row.proba) == {"a", "b"}
