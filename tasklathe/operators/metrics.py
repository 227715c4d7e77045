"""Metrics as frames: counters over events, gauges over tables, and the two distributions.

Where the source sends a constant (latency 0, empty queue labels), ``as_sent``
keeps it; without, the true value is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import liveness, to_millis

COUNTED = {"tasks_created_total": 1, "tasks_completed_total": 4, "tasks_failed_total": 5, "tasks_retried_total": 6}


def event_counters(events: DataFrame, as_sent: bool = True) -> DataFrame:
    """``metric``, ``queue_name``, ``value`` from events by new state; only creations carry their queue as sent."""
    name = F.lit(None).cast("string")
    for metric, code in COUNTED.items():
        name = F.when(F.col("new_status") == code, metric).otherwise(name)
    queue = F.when(F.col("new_status") == 1, F.col("queue_name")).otherwise("") if as_sent else F.col("queue_name")
    told = events.select(name.alias("metric"), queue.alias("queue_name")).where("metric IS NOT NULL")
    return told.groupBy("metric", "queue_name").agg(F.count(F.lit(1)).alias("value"))


def exposition(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """``line``: metrics in the text form that scrapers read, the queue as a label where there is one."""
    safe = F.col("queue_name")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        safe = F.replace(safe, F.lit(plain), F.lit(escaped))
    label = F.when(F.coalesce("queue_name", F.lit("")) != "", F.concat(F.lit('{queue="'), safe, F.lit('"}'))).otherwise("")
    return metrics.select(F.concat(F.lit(prefix), "metric", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


def dead_lettered(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.groupBy("queue_name").agg(F.count(F.lit(1)).alias("value"))


def active_workers(workers: DataFrame) -> DataFrame:
    """Workers that aren't dead by their heartbeat's age."""
    return workers.where(liveness(F.col("heartbeat_age_s")) != "Dead").agg(F.count(F.lit(1)).alias("value"))


def _percentiles(millis, marks: tuple[float, ...]) -> list:
    """Exact percentiles, to whole milliseconds."""
    return [F.round(F.percentile(millis, m)).cast("long").alias(f"p{round(m * 100)}") for m in marks]


def dispatch_latency(tasks: DataFrame, runs: DataFrame, marks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Exact percentiles of first start less creation, in milliseconds, by queue (an extension: the source sends 0)."""
    first = runs.where("attempt_number = 1").select(F.col("task_id").alias("id"), "started_at")
    wait = to_millis(F.col("started_at")) - to_millis(F.col("created_at"))
    return tasks.join(first, "id").groupBy("queue_name").agg(*_percentiles(wait, marks), F.count(F.lit(1)).alias("n"))


def run_duration(runs: DataFrame, marks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Exact percentiles of completion less start, in milliseconds, by state (an extension: the source never records it)."""
    took = to_millis(F.col("completed_at")) - to_millis(F.col("started_at"))
    return runs.where("completed_at IS NOT NULL").groupBy("status").agg(*_percentiles(took, marks), F.count(F.lit(1)).alias("n"))
