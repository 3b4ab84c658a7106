"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from widesift.llm import components, simhash, vectors


def sets(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    frame = spark.createDataFrame(edges + [(None, 5), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == sets(edges, nodes)
    assert components.connected_components(frame.limit(0)).count() == 0


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, fp string, rep string").repartition(3)
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [slow_print(t) for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == prints
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert {i: r.component for i, r in got.items()} == sets(pairs, range(len(texts)))


def test_simhash_texts(spark):
    r = random.Random(1)
    base = [[r.choice("abcdefgh") * r.randint(1, 5) for _ in range(400)] for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One", "one two", "É é", "x " * 50_000, "x " * 50_000]
    for words in base:
        for _ in range(6):
            copy = list(words)
            copy[r.randrange(400)] = "zz"
            texts.append(" ".join(copy))
    check_simhash(spark, texts)


def test_simhash_links_with_cut_nodes(spark, monkeypatch):
    """Dense fingerprints, with nodes cut into chunks and a small frontier."""
    monkeypatch.setattr(simhash, "NODE_ROWS", 20)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = np.random.default_rng(3)
    values = set()
    for start in rng.integers(0, 2 ** 63, 6):
        for _ in range(60):
            value = int(start)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                value ^= 1 << int(bit)
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")).collect()
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    assert sets([(r.a, r.b) for r in links], range(len(values))) == sets(pairs, range(len(values)))


def test_simhash_of_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (0, "other text here now")], "doc_id long, text string")
    got = sorted(((r.id is None, r.id or 0), r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == [((False, 0), 0), ((False, 1), 1), ((False, 1), 1), ((True, 0), None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def unit(rng, dims):
    x = rng.standard_normal(dims)
    return x / np.linalg.norm(x)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEET", 50)  # cells are cut
    rng = np.random.default_rng(0)
    rows = []
    for group in range(25):
        centre = unit(rng, 32)
        for _ in range(1 + group * 3):
            near = centre + unit(rng, 32) * rng.uniform(0, 0.16)
            rows.append((len(rows), [float(np.float32(x)) for x in near * rng.uniform(0.5, 9)], int(group % 3)))
    rows += [(len(rows) + i, v, label) for i, (v, label) in enumerate([
        (rows[5][1], 0), (rows[5][1], 0), (rows[5][1], None), (None, 0), ([], 0), ([0.0] * 32, 0), ([float("nan")] + [1.0] * 31, 0), ([None] + [1.0] * 31, 0),
        ([float("inf")] * 32, 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([1e30] * 32, 1), ([1e-30] * 32, 1)])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, class string").repartition(5)
    got = {r.id: r for r in vectors.near_duplicates(frame, recall=0.999).collect()}
    usable = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            x /= np.abs(x).max()
            usable[i] = (x / np.linalg.norm(x), label)
    pairs = [(i, j) for i in usable for j in usable if j < i and usable[i][1] == usable[j][1] and len(usable[i][0]) == len(usable[j][0])
             and usable[i][0] @ usable[j][0] >= 0.98]
    links = dict.fromkeys(range(len(rows)), 0)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    found = sum(r.n_links for r in got.values()) / (2 * len(pairs))
    assert all(got[i].n_links <= links[i] for i in links) and found >= 0.99
    right = sets(pairs, range(len(rows)))
    assert np.mean([got[i].component == right[i] for i in right]) >= 0.99
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_two_lengths(spark):
    """Links at the threshold are found among short vectors although the table has long ones too."""
    rng = np.random.default_rng(2)
    rows, pairs = [], 300
    for dims in (16, 1024):
        for _ in range(pairs):
            x, side = unit(rng, dims), unit(rng, dims)
            side -= (side @ x) * x
            y = 0.981 * x + np.sqrt(1 - 0.981 ** 2) * side / np.linalg.norm(side)
            rows += [(len(rows), x.tolist(), 0), (len(rows) + 1, y.tolist(), 0)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    linked = {r.id for r in found if r.n_links}
    assert all(len(linked & set(range(start, start + 2 * pairs))) >= 0.97 * 2 * pairs for start in (0, 2 * pairs))


def test_plan_reaches_the_recall_it_is_made_for():
    for n in (100, 10_000, 10 ** 8):
        plan = vectors.Plan.for_recall(n, 64, 0.98, 0.99)
        rng = np.random.default_rng(1)
        x = np.array([unit(rng, 64) for _ in range(1500)])
        side = np.array([unit(rng, 64) for _ in range(1500)])
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        same = (vectors._cells(x, plan) == vectors._cells(y, plan)).any(axis=1)
        away = np.abs((x - y) @ vectors._directions(64, plan.directions, 13)) <= plan.window
        assert (same & (away.sum(axis=1) >= plan.collisions)).mean() >= 0.97
