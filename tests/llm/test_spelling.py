"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from widesift.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def slow_groups(words):
    found, form = {}, {}
    for w, n in words.items():
        others = sorted(((-words[v], v) for v in words if v != w and near(v, w)))
        best = others[0] if others and -others[0][0] >= 2 * n else None
        form[w] = best and best[1]
        found[w] = (n, len(others), best and best[1], best and -best[0])
    result = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        result[w] = (*found[w], root)
    return result


def slow_vocabulary(rows, least_length=5, least_n=3):
    counts = Counter()
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lowered)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_n}


def grouped(spark, words, **how):
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return {r.word: tuple(r)[1:] for r in spelling.group_variants(frame, **how).select("word", "n", "n_near", "form", "form_n", "root").collect()}


@pytest.mark.parametrize("seed", range(150))
def test_acceptor(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 60))})
    acceptor = spelling.Acceptor(words)
    assert sorted(map(spelling._unchained, acceptor._equal(acceptor.initial, acceptor.initial))) == words
    got = [tuple(sorted(p)) for p in acceptor.one_edit()]
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1:] if near(a, b)}
    assert len(got) == len(want) and set(got) == want


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(a + b for a in "abc" for b in ("ing", "ed", "")))
    # i n g and e d fold into one chain each behind a single state after the first letter
    assert len(acceptor.arcs) == 6


@pytest.mark.parametrize("seed,most", [(0, 10_000), (1, 1), (2, 3), (3, 20)])
def test_groups(spark, seed, most):
    """The same result wherever prefixes are split, down to one word."""
    r = random.Random(seed)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 7))): r.choice([3, 3, 5, 6, 12, 24, 100]) for _ in range(400)}
    assert grouped(spark, words, most=most) == slow_groups(words)


def test_chains_of_forms(spark):
    words = {"aaaaa" + "b" * i: 3 << i for i in range(12)} | {"zzzzz": 3, "zzzzy": 6, "zzzzx": 6}
    got = grouped(spark, words, most=4)
    assert got == slow_groups(words) and got["aaaaa"][4] == "aaaaa" + "b" * 11
    assert got["zzzzz"][2] == "zzzzx"  # ties: the smallest


def test_long_words_and_none(spark):
    long = "ab" * 20_000
    words = {long: 10, long[:-1]: 4, long[:1000] + "x" + long[1001:]: 5, "c" * 30_000: 3}
    got = grouped(spark, words)
    assert got[long][:2] == (10, 2) and got[long[:-1]][2] == long
    assert grouped(spark, {}) == {}


def test_vocabulary(spark):
    r = random.Random(5)
    pool = ["house", "Mouse", "Élan", "ÉLANS", "über×fluß", "a", "words", "HOUSE", "tree"]
    rows = [(r.choice([i, None]), " ".join(r.choice(pool) + r.choice(["", ".", "1", "-"]) for _ in range(60))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "1 2 3"), (903, "longish " * 5000)] + [(904, "twice again again again")] * 2
    frame = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int")
    got = {x.word: x.n for x in spelling.vocabulary(frame).collect()}
    assert got == slow_vocabulary(rows)
