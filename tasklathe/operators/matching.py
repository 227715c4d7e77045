"""Matching tasks with waiting workers, as joins on ranks.

A snapshot is matched at once: the n-th task offered to a partition meets its
n-th waiting slot.  Tasks left over climb the partition tree, hop by hop, and meet
the slots left over there.  (The source hands tasks out one at a time, so a task
that climbs may there take a slot before a later task of that partition does.)
Order is the order of offers; priority counts in dequeuing only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import liveness


def partition_tree(spark: SparkSession, partitions: int, branching: int) -> DataFrame:
    """``partition_id``, ``parent_id`` (null at the root), ``depth``, ``children``."""
    p = F.col("partition_id")
    tree = spark.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    tree = tree.withColumn("parent_id", F.when(p > 0, F.floor((p - 1) / branching)).cast("int"))
    depth, at = F.lit(0), p
    for _ in range(tree_height(partitions, branching)):
        depth = depth + F.when(at > 0, 1).otherwise(0)
        at = F.when(at > 0, F.floor((at - 1) / branching)).otherwise(F.lit(0)).cast("int")
    first = p * branching + 1
    inside = F.filter(F.sequence(first, first + branching - 1), lambda c: c < partitions)
    return tree.withColumn("depth", depth).withColumn("children", inside)


def tree_height(partitions: int, branching: int) -> int:
    """Hops from the farthest partition to the root."""
    at, hops = partitions - 1, 0
    while at > 0:
        at, hops = (at - 1) // branching, hops + 1
    return hops


def without_dead(slots: DataFrame, workers: DataFrame) -> DataFrame:
    """Slots whose worker isn't dead; ``workers`` has ``id`` and ``heartbeat_age_s``.  Slots of unknown workers stay."""
    dead = workers.where(liveness(F.col("heartbeat_age_s")) == "Dead").select(F.col("id").alias("worker_id"))
    return slots.join(dead, "worker_id", "left_anti")


def deregistered(slots: DataFrame, worker_ids: DataFrame) -> DataFrame:
    return slots.join(worker_ids.select("worker_id").distinct(), "worker_id", "left_anti")


def worker_slots(workers: DataFrame, partitions: int) -> DataFrame:
    """A waiting slot on every partition of every queue of a worker that has a free place, whatever their number.

    workers has ``worker_id``, ``queues`` (array) and ``free``.  How many tasks a
    worker takes is bounded where it is matched (``match_workers``).
    """
    spread = workers.select("worker_id", "free", F.posexplode("queues").alias("q", "queue_name")).select("*", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition_id"))
    slots = spread.withColumn("slot_seq", F.col("q") * partitions + F.col("partition_id"))
    return slots.where("free > 0").select("worker_id", "queue_name", "partition_id", "slot_seq")


def _ranked(frame: DataFrame, *order: str) -> DataFrame:
    return frame.withColumn("k", F.row_number().over(Window.partitionBy("queue_name", "partition_id").orderBy(*order)))


def match_fifo(tasks: DataFrame, slots: DataFrame) -> DataFrame:
    """Pairs ``id``, ``slot``: tasks (``id``, ``queue_name``, ``partition_id``, ``seq``) with slots (``slot`` and the like) of their partition."""
    left = _ranked(tasks, "seq", "id")
    right = _ranked(slots, "seq", "slot").select("slot", "queue_name", "partition_id", "k")
    return left.join(right, ["queue_name", "partition_id", "k"]).select("id", "slot", "queue_name", "partition_id")


def match_workers(tasks: DataFrame, workers: DataFrame, partitions: int, rounds: int) -> DataFrame:
    """``id``, ``worker_id``, ``queue_name``, ``partition_id``, ``round``: tasks that waiting workers take.

    In each round every worker with a place left waits on all partitions of its
    queues and takes the first task that it is offered; the others go back.  With
    as many rounds as the largest number of free places all places can be filled.
    """
    open_tasks, hits = tasks, None
    for turn in range(1, rounds + 1):
        slots = worker_slots(workers.where(F.col("free") >= turn), partitions).withColumns({"seq": F.lit(0), "slot": F.col("worker_id")})
        offered = match_fifo(open_tasks, slots).withColumnRenamed("slot", "worker_id").join(open_tasks.select("id", "seq"), "id")
        first = Window.partitionBy("worker_id").orderBy("seq", "id")
        taken = offered.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "worker_id", "queue_name", "partition_id", F.lit(turn).alias("round"))
        hits = taken if hits is None else hits.unionByName(taken)
        open_tasks = leftovers(open_tasks, taken)
    return hits


def leftovers(tasks: DataFrame, matched: DataFrame) -> DataFrame:
    return tasks.join(matched.select("id"), "id", "left_anti")


def match_tree(tasks: DataFrame, slots: DataFrame, partitions: int, branching: int) -> DataFrame:
    """Direct matches, then matches up the tree: ``id``, ``slot``, ``queue_name``, ``partition_id`` (the slot's), ``hops``."""
    found = match_fifo(tasks, slots).withColumn("hops", F.lit(0))
    open_tasks, open_slots, hits = leftovers(tasks, found), slots.join(found.select("slot"), "slot", "left_anti"), found
    for hop in range(1, tree_height(partitions, branching) + 1):
        climbing = open_tasks.where("partition_id > 0").withColumn("partition_id", F.floor((F.col("partition_id") - 1) / branching).cast("int"))
        more = match_fifo(climbing, open_slots).withColumn("hops", F.lit(hop))
        hits = hits.unionByName(more)
        open_tasks, open_slots = leftovers(climbing, more), open_slots.join(more.select("slot"), "slot", "left_anti")
    return hits


def buffered(tasks: DataFrame, matched: DataFrame, capacity: int = 1000) -> DataFrame:
    """Unmatched tasks in order of offer: the first ``capacity`` of a partition are BUFFERED, the others RESET_PENDING."""
    waiting = _ranked(leftovers(tasks, matched), "seq", "id")
    return waiting.select("id", "queue_name", "partition_id", F.when(F.col("k") <= capacity, "BUFFERED").otherwise("RESET_PENDING").alias("outcome"))


def match_totals(matched: DataFrame, offered_by_reader: DataFrame) -> DataFrame:
    """``sync`` counts every match, ``async`` those of tasks that a reader offered (which count in both)."""
    read = offered_by_reader.select("id").withColumn("__read", F.lit(True))
    return matched.join(read, "id", "left").agg(F.count(F.lit(1)).alias("sync"), F.count("__read").alias("async"))
