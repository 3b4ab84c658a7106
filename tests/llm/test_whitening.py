"""Contour integration against the library's eigenvectors, and exact sums against Python's whole numbers."""

import numpy as np
import pytest

from widesift.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, key string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)


def check(spark, rows, wanted=8):
    got = whitening.whitened_components(frame(spark, rows), wanted).toPandas()
    fine = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in fine)
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in np.pad(v, (0, dims - len(v)))] for _, v in fine], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(float)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(wanted, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == n * k and set(got.n) == {n} and got.component.max() == k
    deviation = {i: int(((n * row - sums) ** 2).sum()) for (i, _), row in zip(fine, x)}
    assert dict(zip(got.vec_id, got.deviation)) == deviation
    assert got.identity_error.max() < 1e-9
    for c, group in got.groupby("component"):
        assert abs(group.explained.iloc[0] - values[c - 1] / values.sum()) < 1e-12
        w = dict(zip(group.vec_id, group.whitened))
        want = {i: v for (i, _), v in zip(fine, centred @ vectors[:, c - 1] / np.sqrt(values[c - 1]))}
        if c == 1 or abs(values[c - 2] - values[c - 1]) > 1e-6 * values[0]:
            sign = 1 if sum(w[i] * want[i] for i in w) > 0 else -1
            assert max(abs(w[i] - sign * want[i]) for i in w) < 1e-7


def test_whitening(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 12)) * (2.0 ** -np.arange(12))
    rows = list(enumerate(x.tolist()))
    check(spark, rows + [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11)])


def test_far_from_the_origin_and_different_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (1000 + rng.standard_normal(int(n))).tolist()) for i, n in enumerate(rng.integers(3, 6, 80))]
    check(spark, rows + [(500, [])], wanted=3)


def test_few_vectors_and_none(spark):
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.5, 1.0]), (3, [0.5, 0.5, 7.0])])  # two components only
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0]), (2, None)], [(1, [])]):
        assert whitening.whitened_components(frame(spark, rows)).count() == 0


def test_sums_beyond_doubles(spark):
    """Products beyond 2^53 and deviations beyond the longs are exact or null."""
    rows = [(i, [float(i) * 2.0 ** 33, 1.0]) for i in range(6)]
    got = {r.vec_id: r.deviation for r in whitening.whitened_components(frame(spark, rows), 1).collect()}
    x = [int(i * 2.0 ** 33 * 1024) for i in range(6)]
    want = {i: (6 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()}


SPECTRA = {"equal": np.ones(20), "two groups": np.r_[np.ones(10), np.full(10, 1e-3)], "geometric": 0.5 ** np.arange(30),
           "close": 1 + 1e-7 * np.arange(12), "steep": np.r_[1e6, 1e3, 1, np.full(9, 1e-3)], "pairs": np.repeat([5.0, 4.0, 3.0, 2.0, 1.0], 2), "one": np.ones(1)}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenpairs(spark, name):
    rng = np.random.default_rng(2)
    values = np.sort(SPECTRA[name])[::-1] / SPECTRA[name].sum()
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = q * values @ q.T
    matrix = (matrix + matrix.T) / 2
    got, vectors = whitening.eigenpairs(spark, matrix, 8)
    wanted = values[:8][values[:8] > 1e-12]
    assert len(got) == len(wanted) and np.abs(got - wanted).max() < 1e-14
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-6
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-14


@pytest.mark.parametrize("seed", range(20))
def test_inertia(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((15, 15))
    a = a + a.T if seed % 2 else a @ a.T * rng.integers(0, 2, (15, 15))
    a = (a + a.T) / 2
    a[np.diag_indices(15)] *= seed % 3
    shift = float(rng.standard_normal())
    assert whitening.above(a, shift) == int((np.linalg.eigvalsh(a) > shift).sum())
