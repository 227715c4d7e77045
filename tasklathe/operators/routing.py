"""Routing: partition owners on a consistent-hash ring, membership changes, readers.

A ring has 64 virtual nodes for each node.  A key belongs to the first virtual
node at or after its hash, or to the first of all.  The ring is a sorted array in
one row, as small as the cluster, and is looked up inside each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import partition_key, portable_hash, vnode_key, vnode_owner

VIRTUAL_NODES = 64


def ring(nodes: DataFrame, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """``h``, ``node`` of every virtual node; ``nodes`` has ``node``."""
    spread = nodes.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    key = vnode_key(F.col("node"), F.col("i"))
    return spread.select(portable_hash(key).alias("h"), vnode_owner(key).alias("node"))


def _successor(points: Column, h: Column) -> Column:
    after = F.filter(points, lambda p: p["h"] >= h)
    return F.coalesce(F.get(after, F.lit(0))["node"], F.get(points, F.lit(0))["node"])


def owners(partitions: DataFrame, nodes: DataFrame, own: str | None = None) -> DataFrame:
    """``queue_name``, ``partition_id``, ``node`` of distinct partitions; on an empty ring all belong to ``own``."""
    points = ring(nodes).agg(F.array_sort(F.collect_list(F.struct("h", "node"))).alias("p"))
    keys = partitions.select("queue_name", "partition_id").distinct().withColumn("h", portable_hash(partition_key(F.col("queue_name"), F.col("partition_id"))))
    told = keys.withColumn("p", points.scalar())
    return told.select("queue_name", "partition_id", F.coalesce(_successor(F.col("p"), F.col("h")), F.lit(own)).alias("node"))


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``node``, ``change`` (joined or left) between two sets of nodes."""
    joined = after.select("node").distinct().join(before, "node", "left_anti").withColumn("change", F.lit("joined"))
    left = before.select("node").distinct().join(after, "node", "left_anti").withColumn("change", F.lit("left"))
    return joined.unionByName(left)


def reconcile_readers(owned: DataFrame, reading: DataFrame) -> DataFrame:
    """``queue_name``, ``partition_id``, ``action``: start what is owned and not read, stop what is read and not owned."""
    keys = ["queue_name", "partition_id"]
    start = owned.select(*keys).distinct().join(reading, keys, "left_anti").withColumn("action", F.lit("start"))
    stop = reading.select(*keys).distinct().join(owned, keys, "left_anti").withColumn("action", F.lit("stop"))
    return start.unionByName(stop)


def wanted_readers(queues: DataFrame, partitions: int, nodes: DataFrame, own: str) -> DataFrame:
    """Partitions of discovered queues that ``own`` is to read."""
    every = queues.select("queue_name").distinct().select("queue_name", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition_id"))
    return owners(every, nodes, own).where(F.col("node") == own).select("queue_name", "partition_id")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Partitions whose owner differs."""
    a = before.select("queue_name", "partition_id", F.col("node").alias("from_node"))
    b = after.select("queue_name", "partition_id", F.col("node").alias("to_node"))
    return a.join(b, ["queue_name", "partition_id"]).where("from_node <> to_node")
