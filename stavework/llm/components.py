"""Connected components by alternating star contractions.

Every round replaces the edges by two groupings: each node's larger neighbours are
linked to its smallest neighbour, then each node's smaller neighbours are. The edges
turn into stars around each component's smallest node in a number of rounds that grows
with the logarithm of its size. A round keeps at most as many edges as it gets, hashes
them by node and is written to the checkpoint folder. The smallest neighbours are a
``min`` with map-side partials, written before the edges are joined with them: a join of
two plain scans whose result is dealt anew is one that adaptive execution can split, so
a node with very many neighbours is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm.common import collected_tables, cut_table, drop_tables


def _smallest(pairs: DataFrame) -> DataFrame:
    return cut_table(pairs.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node a: neighbours above a are linked to the least of a and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both)
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node a: a and its neighbours below a are linked to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _smallest(down)
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Root of every node that an edge names.

    edges: two columns ``a``, ``b`` of one ordered type, in any direction, repeated or
    not; null ends and loops are ignored. Returns ``node``, ``root`` (the smallest node
    of its component), one row for each node of an edge between different nodes.
    """
    spark, seen = edges.sparkSession, None
    with collected_tables() as before:
        edges = cut_table(edges.select("a", "b").where("a <> b").distinct())
    while True:
        # a round of each kind before each look at the result, whose tables then go
        with collected_tables() as written:
            edges = cut_table(_small_star(_large_star(edges)))
        drop_tables(spark, [*before[-1:], *written[:-1]])
        before = written
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
