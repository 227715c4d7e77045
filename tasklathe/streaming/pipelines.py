"""Event, log and heartbeat streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import level_name, liveness, moment
from ..operators import events as E
from ..operators import metrics, reads
from ..schemas import EVENTS

LOG_ENTRY = "task_run_id string, timestamp_ms bigint, level int, message string, metadata string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as they arrive in a folder of Parquet files, with their time in ``ts``."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.timestamp_millis("timestamp_ms"))


def relay_stream(events: DataFrame, node_id: str, delay: str = "10 minutes") -> DataFrame:
    """A node's own and unmarked events, each once within the delay."""
    return E.to_relay(events, node_id).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def for_queue(events: DataFrame, queue: str | None = None) -> DataFrame:
    """Events of one queue (an extension: the source's event stream takes such a filter and ignores it)."""
    return reads.where_equal(events, queue_name=queue)


def counters_by_window(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events by queue, state and time window, closed once the watermark has passed (an extension)."""
    span = F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(span.alias("w"), "queue_name", "new_status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "queue_name", "new_status", "n")


def counters(events: DataFrame) -> DataFrame:
    """Running totals; use the complete or update mode."""
    return metrics.event_counters(events)


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Log rows from JSON entries; unknown levels read as INFO, metadata that isn't JSON as null."""
    raw = spark.readStream.schema(LOG_ENTRY).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.select("task_run_id", "timestamp_ms", level_name(F.col("level")).alias("level"), "message", F.to_json(F.try_parse_json("metadata")).alias("metadata"))


def ingest_logs(logs: DataFrame, path: str, checkpoint: str, interval: str | None = "500 milliseconds") -> StreamingQuery:
    """Append log rows to a Parquet table in micro-batches; without an interval, all there is and then end.

    A failing write stops the query rather than dropping the batch.
    """
    writer = logs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def keep_recent(events: DataFrame, store: Callable[[DataFrame], None], load: Callable[[], DataFrame | None], checkpoint: str, limit: int = 200) -> StreamingQuery:
    """The newest events, merged batch by batch: ``load`` gives what was kept, ``store`` takes the new list."""

    def merge(batch: DataFrame, _: int) -> None:
        kept = load()
        store(reads.recent(batch if kept is None else kept.unionByName(batch), limit))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sse_stream(events: DataFrame) -> DataFrame:
    return E.sse_payload(events)


def last_heartbeats(heartbeats: DataFrame) -> DataFrame:
    """``worker_id``, ``last_heartbeat``; use the complete or update mode."""
    return heartbeats.groupBy("worker_id").agg(F.max("ts").alias("last_heartbeat"))


def liveness_at(last: DataFrame, as_of) -> DataFrame:
    """State of each worker by the age of its last heartbeat."""
    age = (F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(F.col("last_heartbeat").cast("timestamp"))) / 1_000_000
    return last.withColumn("liveness", liveness(age))
