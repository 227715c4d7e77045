"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparkio import durable, release


def _edges(big: Column, small: Column) -> list[Column]:
    return [big.alias("a"), small.alias("b")]


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns ``a``, ``b``, long) that isn't its own root.

    root is the smallest node reachable.  Each round links every neighbour of a
    node to the smallest one near it (large star), then the smaller ones among
    themselves (small star); rounds grow with the logarithm of the number of
    nodes.  A hub's neighbours are never gathered: its minimum is a partial
    aggregate, and the join that hands it back can be split where it is skewed.
    Self-edges and nulls are ignored; an empty table has no nodes.
    """
    now = durable(edges.select(*_edges(F.greatest("a", "b"), F.least("a", "b"))).where("a > b").distinct())
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(*_edges(F.col("v"), F.col("m"))).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a").select(*_edges(F.greatest("b", "m"), F.least("b", "m"))).where("a > b")
        before, now = now, durable(linked.union(least.select(*_edges(F.col("a"), F.col("m")))).distinct())
        release(before)
        inner = now.select(F.col("b").alias("a")).distinct().join(now, "a", "left_semi")
        twice = now.groupBy("a").count().where("count > 1").select("a")
        if inner.union(twice).isEmpty():
            found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found._stands_in = now._stands_in
            return found
