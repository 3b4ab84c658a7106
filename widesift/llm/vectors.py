"""Embedding near-duplicates by collision-counting projections.

Vectors of one label are projected on random directions. Two vectors within the cosine threshold lie close together on most
of them, two others on few. A pair is verified when it collides, within a window around the one vector's projection, on as
many of the directions as linked pairs reach with the asked recall. Which pairs are counted at all is decided by tables of a few
projections cut into cells; width, projections to a table and number of tables follow from recall and number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from widesift.llm.components import connected_components
from widesift.session import cut_lineage

#: vectors in a cell that are aimed at, vectors of one cell that meet in one task at most, and rows of a task on average
CELL = 128
MEET = 4096
TASK_ROWS = 40_000
QUERIES = 128
PAIRS = 1 << 15


@dataclass(frozen=True)
class Plan:
    """How pairs at the threshold are found with the recall asked for."""

    cosine: float
    width: float  # of cells
    per_table: int
    tables: int
    window: float  # half of it
    directions: int
    collisions: int

    @classmethod
    def for_recall(cls, n: int, dims: int, cosine: float, recall: float, directions: int = 16) -> Plan:
        """Half of the allowed loss goes to the tables and half to the counting; n is the largest number of vectors of a label and length."""
        loss = (1 - recall) / 2
        # along a random unit direction two vectors at the threshold differ by a normal number of this deviation
        sigma = math.sqrt(2 - 2 * cosine) / math.sqrt(dims)
        width = 6 * sigma
        together = 1 - math.sqrt(2 / math.pi) * sigma / width
        spread = 1 / math.sqrt(dims)
        apart = min(0.9, width / (2 * math.sqrt(math.pi) * spread))  # two vectors of an even cloud in one cell
        per_table = max(1, math.ceil(math.log(max(1.0, n / CELL)) / -math.log(apart)))
        tables = max(1, math.ceil(math.log(loss) / math.log(1 - together ** per_table)))
        close = math.erf(2 / math.sqrt(2))
        tail, needed = 1.0, 0
        for k in range(directions):
            tail -= math.comb(directions, k) * close ** k * (1 - close) ** (directions - k)
            if 1 - tail > loss:
                break
            needed = k + 1
        return cls(cosine, width, per_table, tables, 2 * sigma, directions, needed)


def _directions(dims: int, n: int, seed: int) -> np.ndarray:
    found = np.random.default_rng(seed).standard_normal((dims, n))
    return found / np.linalg.norm(found, axis=0)


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares stay finite."""
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(x: np.ndarray, plan: Plan) -> np.ndarray:
    """One 64-bit key for each vector and table."""
    rng = np.random.default_rng(7)
    places = x @ _directions(x.shape[1], plan.tables * plan.per_table, 11) / plan.width + rng.random(plan.tables * plan.per_table)
    cells = np.floor(places).astype(np.int64).reshape(len(x), plan.tables, plan.per_table)
    factors = rng.integers(1, 2 ** 62, (plan.tables, plan.per_table)) | 1
    return (cells * factors).sum(axis=2)


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _links(classes: DataFrame, plan_of: Callable[[int], Plan]) -> DataFrame:
    """(a, b, n): for every class a the rows of other classes linked to it (b = a), and links (b < a) that connect what is linked.

    A pair is counted in the first table in which it shares a cell. `plan_of` gives the plan of a vector length; all have as many tables.
    """
    kind = classes.schema["vector"].dataType.simpleString()
    fields = f"rep bigint, n bigint, label string, vector {kind}, keys array<bigint>"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, part in frame.groupby(frame["vector"].map(len)):
                yield part.assign(keys=list(_cells(_unit(part["vector"]), plan_of(dims))))[["rep", "n", "label", "vector", "keys"]]

    placed = cut_lineage(classes.mapInPandas(place, fields))
    rows = placed.select("*", F.posexplode("keys").alias("table", "key")).withColumn("dims", F.size("vector"))
    cell = ["table", "key", "label", "dims"]
    large = cut_lineage(placed.select("label", F.size("vector").alias("dims"), F.posexplode("keys").alias("table", "key")).groupBy(*cell).count()
                        .where(F.col("count") > MEET).select(*cell, F.ceil(F.col("count") / MEET).cast("int").alias("chunks")))
    if large.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "chunk": F.lit(0)})
    else:  # every pair of chunks of a cell meets in a task of its own
        rows = rows.join(large, cell, "left").fillna(1, ["chunks"])
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("chunks", "other")
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, -(-placed.count() * plan_of(1).tables // TASK_ROWS))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        frame = pd.concat(held, ignore_index=True)
        ids, member = np.unique(frame["rep"].to_numpy(), return_inverse=True)
        count = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for (table, _, _, dims, i, j), part in frame.groupby(["table", "key", "label", "dims", "i", "j"], sort=False):
            if len(part) < 2:
                continue
            at, n, chunk = member[part.index], part["n"].to_numpy(), part["chunk"].to_numpy()
            for a, b in _collide(_unit(part["vector"]), np.array(part["keys"].tolist()), table, chunk if i != j else None, plan_of(dims)):
                np.add.at(count, at[a], n[b])
                np.add.at(count, at[b], n[a])
                _join(root, at[a], at[b])
        hit, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(ids)))
        yield pd.DataFrame({"a": np.concatenate([ids[hit], ids[moved]]), "b": np.concatenate([ids[hit], ids[root[moved]]]),
                            "n": np.concatenate([count[hit], np.zeros(len(moved), np.int64)])})

    return rows.repartition(tasks, *cell, "i", "j").mapInPandas(meet, "a bigint, b bigint, n bigint")


def _collide(x: np.ndarray, keys: np.ndarray, table: int, chunk: np.ndarray | None, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one cell that share no cell of an earlier table; with chunks, pairs across the two of them."""
    places = x @ _directions(x.shape[1], plan.directions, 13)
    order = np.argsort(places, axis=0)
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(len(x))[:, None], axis=0)
    low, high = np.empty_like(order), np.empty_like(order)
    for d in range(plan.directions):
        line = places[order[:, d], d]
        low[:, d] = np.searchsorted(line, places[:, d] - plan.window, "left")
        high[:, d] = np.searchsorted(line, places[:, d] + plan.window, "right")
    for start in range(0, len(x), QUERIES):
        block = slice(start, start + QUERIES)
        seen = np.zeros((len(x[block]), len(x)), np.uint8)
        for d in range(plan.directions):
            seen += (ranks[:, d] >= low[block, d, None]) & (ranks[:, d] < high[block, d, None])
        a, b = np.nonzero(seen >= plan.collisions)
        a = a + start
        ahead = a < b
        if chunk is not None:
            ahead &= chunk[a] != chunk[b]
        a, b = a[ahead], b[ahead]
        for i in range(0, len(a), PAIRS):
            p, q = a[i:i + PAIRS], b[i:i + PAIRS]
            linked = np.einsum("ij,ij->i", x[p], x[q]) >= plan.cosine
            p, q = p[linked], q[linked]
            first = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
            yield p[first], q[first]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of sets in place; the root of a set is its smallest member."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(root, a, b)
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(id, n_links, component) for every row: rows of equal label within the cosine, and the smallest id reachable over links.

    No link is below the threshold; links at it are found with `recall` in expectation, closer ones more often, equal vectors
    always. Equal vectors are one class and are never compared. Rows whose vector or label is null, whose vector is empty, zero or
    has a null or non-finite component link with nothing, nor do vectors of different lengths. Ids are long; rows that share one
    count each, and a row without an id has no component of its own. Extra columns are left behind.
    """
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & F.col("id").isNotNull() & _usable(F.col("vector")))
    address = F.sha2(F.concat_ws(",", F.size("vector"), "label", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")), 256)
    rows = rows.withColumn("class", F.when(F.col("usable"), F.unhex(address)))
    classes = cut_lineage(rows.where("usable").groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                                                   F.first("label").alias("label"), F.first("vector").alias("vector")))
    # only vectors of one label and length meet; widths follow from the length, everything else from the largest number of them
    most = classes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 1
    found = cut_lineage(_links(classes.select("rep", "n", "label", "vector"), lambda dims: Plan.for_recall(most, dims, cosine, recall)))
    parts = connected_components(found.where("a != b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    named = cut_lineage(classes.select("class", "rep", "n").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
                        .select("class", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                                F.coalesce("component", "rep").alias("component")))
    return rows.select("id", "class").join(named, "class", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
