"""Line deduplication against plain Python."""

import os
import random
from collections import defaultdict

import pytest

from widesift.llm import line_runs
from widesift.session import checkpoint_folder

SCHEMA = "doc_id long, text string, hi string, at string, batch string, places string, cut string"


def slow(rows, least_length=20, least_docs=3):
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lowered)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    frequent = {k: max(ids, key=rank) for k, ids in holders.items() if len(k) >= least_length and len(ids) >= least_docs}
    found = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if frequent.get(key(line), i) == i]
        found.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


def check(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in line_runs.drop_frequent_lines(frame, **how).collect()]
    assert sorted(got, key=repr) == slow(rows)


def corpus(seed):
    r = random.Random(seed)
    shared = ["A line that stands in Many documents", "Ünïcode Zeile, die sich Überall findet", " an em space is no blank here.......", "short", "x" * 20, "y" * 19]
    rows = []
    for i in range(60):
        lines = [r.choice(shared) if r.random() < 0.4 else f"line {r.randint(0, 400)} of its own, or nearly" for _ in range(r.randint(0, 8))]
        lines = [r.choice(["", " ", "\t\x0b", "\r"]) + (s.upper() if r.random() < 0.2 and s.isascii() else s) + r.choice(["", "  ", "\r", "\x0c"]) for s in lines]
        rows.append((r.choice([i, i, i, 7, None]), "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 20), (103, "x" * 20), (104, "x" * 20 + "\n" + "x" * 20)]


@pytest.mark.parametrize("seed,batches", [(0, 1), (1, 4), (2, 7)])
def test_lines(spark, seed, batches):
    check(spark, corpus(seed), batches=batches)


def test_empty_long_and_extreme(spark):
    check(spark, [])
    check(spark, [(None, None)])
    line = "the very same line, over and over"
    check(spark, [(1, "\n".join([line] * 50_000)), (2, "\n".join([line, "z" * 300_000] * 2)), (3, line), (-2**62, line), (2**62, line + "\n" + line)])
    left = [f for f in os.listdir(checkpoint_folder(spark).removeprefix("file:")) if f.startswith("lines-")]
    assert not left and not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_runs_hold_every_batch_and_grow_in_levels(spark, tmp_path):
    """Batches in any order; what is frequent is the same, and a batch meets few runs."""
    r = random.Random(3)
    rows = [(r.randint(0, 40), r.randint(0, 1), i) for i in range(300) for _ in range(2)]
    for order in (range(10), reversed(range(10))):
        known = line_runs.LineRuns(spark, str(tmp_path), buckets=3)
        for i in order:
            known.add(spark.createDataFrame([x for x in rows if x[2] % 10 == i], "hi long, lo long, doc_id long"))
            assert len(known.runs()) <= 4
        got = {(x.hi, x.lo): x["last"] for x in known.frequent().collect()}
        known.close()
        holders = defaultdict(set)
        for hi, lo, i in rows:
            holders[hi, lo].add(i)
        assert got == {k: max(v) for k, v in holders.items() if len(v) >= 3}


def test_what_is_known_is_not_stored_again(spark, tmp_path):
    known = line_runs.LineRuns(spark, str(tmp_path), buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "hi long, lo long, n long, last long")
    known.add(spark.createDataFrame([(1, 1, i) for i in range(90, 99)] + [(2, 2, 95)], "hi long, lo long, doc_id long"))
    left = known.news(frame([(1, 1, 4, 50), (1, 1, 4, 99), (1, 1, 2, None), (2, 2, 1, 50), (1, 2, 1, 1)])).collect()
    assert sorted(tuple(r) for r in left) == [(1, 1, 4, 99), (1, 2, 1, 1), (2, 2, 1, 50)]
    plan = known.news(frame([(1, 1, 4, 50)]))._jdf.queryExecution().toString()
    # only the batch is shuffled: runs lie in the buckets that the join asks for
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 1
    known.close()
