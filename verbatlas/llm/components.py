"""Connected components by alternating large and small stars over edge tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): each node's least neighbour or itself. edges: (u, v) in the directions that count."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root: the least node that it is connected with.

    A node with many neighbours is joined with its minimum, never gathered; rounds grow with the logarithm
    of the nodes.
    """
    e = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while before != (now := _state(e)):
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stored(large, "edges")
        least = _least(large)
        small = large.join(least, "u")
        e = common.stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
