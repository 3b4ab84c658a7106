"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Two fingerprints within three bits differ in at most one bit of their upper or of their lower half. The
join therefore walks two tries, one over the fingerprints as they are and one with the halves swapped,
and allows one differing bit in the first half of the path and `radius` in all. A fingerprint is dealt to
its own node at a depth that follows from the number of fingerprints, and to the nodes one bit away; a
task then descends the node pairs it has been dealt together, adds up differing bits and drops a pair
of nodes as soon as its budget is used up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from widesift.llm.components import connected_components
from widesift.session import cut_lineage

BITS = 64
HALF = 32
#: rows a task is dealt on average, rows of one node in a group before it is cut, node pairs held at once
TASK_ROWS = 200_000
NODE_ROWS = 20_000
FRONTIER = 500_000
#: a pair of nodes with so few pairs of leaves is compared leaf by leaf
LEAVES = 16
SLICE = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Fingerprint of a text: a bit is set if over half of the shingle hashes have it; zero without words.

    Only A-Z are lower-cased, words are what ASCII white space separates, repeated shingles count again.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    shingles = list(map(b" ".join, zip(*(parts[i:] for i in range(words))))) or [b" ".join(parts)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), SLICE):
        part = shingles[i:i + SLICE]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) for every row; fp holds the 64 bits as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _depth(n: int) -> int:
    """Depth at which nodes hold some tens of fingerprints if they spread evenly."""
    return int(np.clip(np.ceil(np.log2(max(n, 1) / 32)), 4, HALF - 1))


def _dealt(classes: DataFrame, depth: int) -> DataFrame:
    """Rows (key, part, side, path, rep): every fingerprint under its own node and those one bit away, in both tries.

    key numbers the pair of nodes, side says which of them the row belongs to, path is the fingerprint with
    the trie's first half on top. part numbers the pairs of chunks of a node with very many fingerprints.
    """
    swapped = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    rows = (classes.select("rep", F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("fp").alias("path")),
                                                    F.struct(F.lit(1).alias("trie"), swapped.alias("path")))).alias("x"))
            .select("rep", "x.trie", "x.path", F.shiftrightunsigned("x.path", BITS - depth).alias("node")))
    rows = rows.withColumn("node", F.col("node") + F.col("trie") * (1 << depth))
    large = cut_lineage(rows.groupBy("node").count().where(F.col("count") > NODE_ROWS)
                        .select("node", F.ceil(F.col("count") / NODE_ROWS).cast("int").alias("chunks")))
    pairs = rows.withColumn("flip", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "other", F.when(F.col("flip") == 0, F.col("node")).otherwise(F.col("node").bitwiseXOR(F.expr("shiftleft(1L, flip - 1)"))))
    if large.isEmpty():
        pairs = pairs.withColumns({"mine": F.lit(1), "theirs": F.lit(1)})
    else:
        pairs = (pairs.join(large.withColumnRenamed("chunks", "mine"), "node", "left")
                 .join(large.select(F.col("node").alias("other"), F.col("chunks").alias("theirs")), "other", "left")
                 .fillna(1, ["mine", "theirs"]))
    chunk = F.pmod(F.xxhash64("rep"), F.col("mine")).cast("int")
    pairs = pairs.withColumn("i", chunk).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    own = F.col("flip") == 0
    upper = F.when(own, F.col("i") > F.col("j")).otherwise(F.col("node") > F.col("other"))
    low, high = F.when(upper, F.col("j")).otherwise(F.col("i")), F.when(upper, F.col("i")).otherwise(F.col("j"))
    return pairs.select((F.least("node", "other") * (depth + 1) + F.col("flip")).alias("key"),
                        (low * 65536 + high).alias("part"), F.when(upper, 1).otherwise(0).alias("side"),
                        (own & (F.col("i") == F.col("j"))).alias("same"), F.when(own, 0).otherwise(1).alias("diff"), "path", "rep")


class _Forest:
    """Union-find over 0..n-1 by numpy: the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.root, a, b)
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _children(range_, ones):
    """The halves of node ranges [lo, hi) of the sorted paths: those with a zero and with a one at the level."""
    lo, hi = range_
    middle = hi - (ones[hi] - ones[lo])
    return (lo, middle), (middle, hi)


def _join_tries(frame: pd.DataFrame, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the node pairs of the frame, as a forest: pairs (rep, smallest rep of its set)."""
    frame = frame.assign(path=frame["path"].to_numpy().view(np.uint64)).sort_values(["key", "part", "side", "path"], kind="stable")
    path, side = frame["path"].to_numpy(), frame["side"].to_numpy()
    reps, member = np.unique(frame["rep"].to_numpy(), return_inverse=True)
    forest = _Forest(len(reps))
    new = np.ones(len(frame), bool)
    new[1:] = (np.diff(frame["key"].to_numpy()) != 0) | (np.diff(frame["part"].to_numpy()) != 0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(frame))
    sides = np.concatenate([[0], np.cumsum(side)])
    cut = end - (sides[end] - sides[begin])
    same, diff = frame["same"].to_numpy()[begin], frame["diff"].to_numpy()[begin].astype(np.int8)
    pairs = (begin, np.where(same, end, cut), np.where(same, begin, cut), end, diff, same)
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, pairs)]
    while stack:
        level, pairs = stack.pop()
        alo, ahi, blo, bhi, diff, same = pairs
        # a pair of nodes whose leaves are in one set already has nothing to add
        sets = forest.root[member]
        turn = np.concatenate([[0], np.cumsum(sets[1:] != sets[:-1])])
        full = (ahi > alo) & (bhi > blo) & ~(same & (ahi - alo < 2))
        x = [p[full] for p in pairs]
        done = (turn[x[0]] == turn[x[1] - 1]) & (turn[x[2]] == turn[x[3] - 1]) & (sets[x[0]] == sets[x[2]])
        alo, ahi, blo, bhi, diff, same = (p[~done] for p in x)
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            for i in range(0, len(alo), FRONTIER):
                stack.append((level, tuple(p[i:i + FRONTIER] for p in (alo, ahi, blo, bhi, diff, same))))
            continue
        few = ((ahi - alo) * (bhi - blo) <= LEAVES) | (level == BITS)
        _compare(path, member, forest, *(p[few] for p in (alo, ahi, blo, bhi)), radius)
        alo, ahi, blo, bhi, diff, same = (p[~few] for p in (alo, ahi, blo, bhi, diff, same))
        if not len(alo):
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((path >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int32)])
        (a0, a1), (b0, b1) = _children((alo, ahi), ones[level]), _children((blo, bhi), ones[level])
        allowed = diff + 1 <= (1 if level < HALF else radius)
        cross = allowed & ~same
        n = np.ones(len(diff), bool)
        parts = [(*a0, *b0, diff, same, n), (*a1, *b1, diff, same, n), (*a0, *b1, diff + 1, np.zeros_like(same), allowed),
                 (*a1, *b0, diff + 1, np.zeros_like(same), cross)]
        stack.append((level + 1, tuple(np.concatenate([p[k][p[6]] for p in parts]) for k in range(6))))
    moved = np.flatnonzero(forest.root != np.arange(len(reps)))
    return reps[moved], reps[forest.root[moved]]


def _compare(path, member, forest: _Forest, alo, ahi, blo, bhi, radius: int) -> None:
    """Joins the sets of all leaf pairs within the radius, a bounded number of pairs at a time."""
    size = (ahi - alo) * (bhi - blo)
    start = np.concatenate([[0], np.cumsum(size)])
    for i in range(0, int(start[-1]), 4 * FRONTIER):
        pair = np.arange(i, min(i + 4 * FRONTIER, int(start[-1])))
        k = np.searchsorted(start, pair, "right") - 1
        a, b = np.divmod(pair - start[k], (bhi - blo)[k])
        a, b = alo[k] + a, blo[k] + b
        near = np.bitwise_count(path[a] ^ path[b]) <= radius
        forest.join(member[a[near]], member[b[near]])


def near_links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between classes (rep, fp) of different fingerprints, enough of them to connect whatever is within the radius.

    At most radius 3 (one bit in one of the halves). Every task returns a forest, so its output is bounded by its
    input however dense a group is; a link may be left out only where its ends are connected by others.
    """
    if radius > 3:
        raise ValueError("two halves guarantee at most radius 3")
    n = classes.count()
    depth = _depth(n)
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, -(-2 * n * (depth + 1) // TASK_ROWS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if rows:
            a, b = _join_tries(pd.concat(rows, ignore_index=True), depth, radius)
            yield pd.DataFrame({"a": a, "b": b})

    return _dealt(classes, depth).repartition(tasks, "key", "part").mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component) for every row: its fingerprint and the smallest id reachable over links of at most `radius` bits.

    Null and empty texts have fingerprint zero and are linked like any other; rows with equal text fall together;
    repeated ids keep a row each. Ids are long; a row without an id has no component. Extra columns are left behind.
    """
    prints = cut_lineage(fingerprints(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, words))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("rep")).where(F.col("rep").isNotNull()))
    found = connected_components(near_links(classes, radius))
    named = cut_lineage(classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component")))
    out = prints.join(named, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
