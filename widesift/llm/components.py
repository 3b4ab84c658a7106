"""Connected components of an edge table, by alternating large and small stars.

Every round replaces the edges of a node by edges to the smallest node in reach, so that the graph turns
into stars in a number of rounds that grows with the logarithm of the diameter. A round is two minimum
aggregations, which combine before the shuffle, and two joins. The minima are written before they are
joined, so that both sides of a join are shuffled for it alone and adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from widesift.session import cut_lineage


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another one; component is the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; an empty table gives an empty table.
    """
    a, b = F.col(left), F.col(right)
    links = cut_lineage(edges.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    before = None
    while (now := _state(links)) != before and now[0]:
        before = now
        links = _small_star(_large_star(links))
    return links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    """Number of edges and a checksum; equal in two rounds once only stars are left."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Joins the larger neighbours of every node to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = cut_lineage(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")))
    # an edge (v > u) is kept as (v, least of u)
    return links.join(least.withColumnRenamed("v", "u"), "u").select("v", F.col("m").alias("u")).where("v != u").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Joins every node and its smaller neighbours to the smallest of them."""
    links = cut_lineage(links)
    least = cut_lineage(links.groupBy("v").agg(F.min("u").alias("m")))
    moved = links.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return cut_lineage(moved.unionByName(least.withColumnRenamed("m", "u")).where("v != u").distinct())
