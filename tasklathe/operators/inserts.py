"""Inserts: new rows with the tables' defaults and the uniqueness rules that guard them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moment, partition_of, stable_id
from ..functions.scalar import json_text

# Defaults of a new task.
DEFAULTS = {"priority": 0, "max_retries": 3, "timeout_seconds": 300, "metadata": "{}"}


def _or_default(frame: DataFrame, name: str, zero_is_unset: bool):
    value = F.col(name) if name in frame.columns else F.lit(None)
    kind = "string" if isinstance(DEFAULTS[name], str) else "int"
    value = value.cast(kind)
    if zero_is_unset and kind == "int" and name != "priority":
        value = F.nullif(value, F.lit(0))
    return F.coalesce(value, F.lit(DEFAULTS[name])).alias(name)


def new_tasks(requests: DataFrame, as_of, partitions: int = 4, zero_is_unset: bool = False) -> DataFrame:
    """Task rows from requests (``queue_name``, ``task_name``, and any of the other columns).

    Missing or null values take the defaults; with ``zero_is_unset`` (requests
    in wire form) 0 does too for retries and timeout.  ``id`` is derived from the
    request where it isn't given.
    """
    have = set(requests.columns)
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string")
    key = F.coalesce(text("id"), stable_id(F.col("queue_name"), F.col("task_name"), F.coalesce(text("idempotency_key"), text("input"), F.lit(""))))
    keyed = requests.withColumn("id", key)
    at = moment(as_of)
    return keyed.select(
        "id", "queue_name", "task_name", partition_of(F.col("queue_name"), F.col("id"), partitions).alias("partition_id"), F.lit("PENDING").alias("status"), text("input").alias("input"),
        _or_default(keyed, "priority", zero_is_unset), _or_default(keyed, "max_retries", zero_is_unset), F.lit(0).alias("attempt_count"), _or_default(keyed, "timeout_seconds", zero_is_unset),
        text("idempotency_key").alias("idempotency_key"), _or_default(keyed, "metadata", zero_is_unset), (F.col("scheduled_at") if "scheduled_at" in have else F.lit(None)).cast("timestamp").alias("scheduled_at"),
        at.cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("error_message"),
    )


def insert_tasks(tasks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the new rows, and the refused ones: their idempotency key is taken, by a row or an earlier new one.

    Keys are unique over all queues; null keys never clash.
    """
    keyed = new.where("idempotency_key IS NOT NULL")
    first = keyed.groupBy("idempotency_key").agg(F.min("id").alias("first"))
    taken = tasks.where("idempotency_key IS NOT NULL").select("idempotency_key").distinct().withColumn("__taken", F.lit(True))
    told = new.join(first, "idempotency_key", "left").join(taken, "idempotency_key", "left")
    refused = F.coalesce(F.col("idempotency_key").isNotNull() & (F.col("__taken").isNotNull() | (F.col("id") != F.col("first"))), F.lit(False))
    pick = lambda f: f.select(*new.columns)
    return tasks.unionByName(pick(told.where(~refused)), allowMissingColumns=True), pick(told.where(refused))


def log_rows(batches: DataFrame, as_of, first_id=0) -> DataFrame:
    """Log rows from column batches: one row of equally long arrays a batch, as bulk inserts send them.

    Levels come as names or, unknown, as INFO; metadata that isn't JSON becomes
    null.  Ids follow the order of ``batch_id`` and place, from ``first_id`` on;
    a batch of no entries adds nothing.
    """
    names = ("task_run_id", "timestamp_ms", "level", "message", "metadata")
    entry = batches.select("batch_id", F.posexplode(F.arrays_zip(*names)).alias("place", "entry"))
    known = F.col("entry.level").isin("DEBUG", "INFO", "WARN", "ERROR")
    sizes = batches.select("batch_id", F.size("task_run_id").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))
    before = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("batch_id", "before")
    at = moment(as_of).cast("timestamp")
    return entry.join(offsets, "batch_id").select(
        (F.lit(first_id) + F.col("before") + F.col("place")).cast("long").alias("id"), F.col("entry.task_run_id").alias("task_run_id"), F.col("entry.timestamp_ms").cast("long").alias("timestamp_ms"),
        F.when(known, F.col("entry.level")).otherwise("INFO").alias("level"), F.col("entry.message").alias("message"), json_text(F.col("entry.metadata")).alias("metadata"), at.alias("created_at"),
    )


def flushes(logs: DataFrame, rows: int = 100, interval_ms: int = 500) -> DataFrame:
    """Log rows with the flush that writes them: ``tick`` of the interval, and ``part`` within it, one for each full buffer.

    The buffer is written when it is full and at every tick, so a tick's rows are
    cut into parts of ``rows``; only a tick's rows are ordered together.
    """
    tick = F.floor(F.col("timestamp_ms") / interval_ms).cast("long")
    order = Window.partitionBy("tick").orderBy("timestamp_ms", "id")
    return logs.withColumn("tick", tick).withColumn("part", F.floor((F.row_number().over(order) - 1) / rows).cast("long"))


def new_signals(requests: DataFrame, as_of) -> DataFrame:
    """Pending signals from ``task_id``, ``signal_name``, ``payload``; one row each, repeats told apart by ``seq``."""
    seq = F.col("seq").cast("string") if "seq" in requests.columns else F.lit("0")
    none = F.lit(None).cast("timestamp")
    key = stable_id(F.col("task_id"), F.col("signal_name"), F.coalesce(F.col("payload"), F.lit("")), seq)
    return requests.select(key.alias("id"), "task_id", "signal_name", json_text(F.col("payload")).alias("payload"), F.lit("PENDING").alias("status"), moment(as_of).cast("timestamp").alias("created_at"), none.alias("delivered_at"), none.alias("acknowledged_at"))
