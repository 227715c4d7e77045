"""Events: derived from two snapshots, filtered for relays, and shaped for consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import level_code, moment, rfc3339, stable_id, status_code, to_millis, wire_text

# Transitions into these states are told; the others pass silently.
TOLD = ("PENDING", "RUNNING", "COMPLETED", "RETRY", "FAILED", "CANCELLED")
# For these the source leaves the queue's name empty.
UNNAMED = ("COMPLETED", "RETRY", "FAILED")


def snapshot_events(before: DataFrame, after: DataFrame, as_of, node_id: str = "", named: bool = False) -> DataFrame:
    """Events of the tasks whose state changed, or that are new and pending.

    previous_status and attempt_number are 0, as the source sends them; ``named``
    fills the queue's name in everywhere.  A return to PENDING isn't told.
    """
    old = before.select("id", F.col("status").alias("old"))
    told = after.join(old, "id", "left").where(F.col("status").isin(*TOLD))
    told = told.where((F.col("old").isNull() & (F.col("status") == "PENDING")) | ((F.col("old") != F.col("status")) & (F.col("status") != "PENDING")))
    queue = F.col("queue_name") if named else F.when(F.col("status").isin(*UNNAMED), "").otherwise(F.col("queue_name"))
    millis = to_millis(moment(as_of))
    return told.select(
        stable_id(F.col("id"), F.col("status"), millis.cast("string")).alias("event_id"), F.col("id").alias("task_id"), queue.alias("queue_name"), F.lit(0).alias("previous_status"), status_code(F.col("status")).alias("new_status"),
        F.lit("").alias("worker_id"), F.lit(node_id).alias("node_id"), F.lit(0).alias("attempt_number"), F.lit("").alias("error_message"), millis.alias("timestamp_ms"),
    )


def to_relay(events: DataFrame, node_id: str) -> DataFrame:
    """Events that this node passes on: its own and unmarked ones."""
    return events.where(F.col("node_id").isin("", node_id))


#: Events that a fan-out keeps for consumers that lag.
FAN_OUT = 4096


def lagging(polls: DataFrame, capacity: int = FAN_OUT) -> DataFrame:
    """``consumer``, ``sent``, ``missed``, ``got``: what consumers of a bounded fan-out lose and receive.

    polls has ``consumer`` and ``sent``, the number of events sent when it reads all
    there is.  Only the newest ``capacity`` are still there; older unread ones are
    lost to it.
    """
    before = F.coalesce(F.lag("sent").over(Window.partitionBy("consumer").orderBy("sent")), F.lit(0))
    oldest = F.col("sent") - capacity
    told = polls.withColumn("read", before)
    return told.select("consumer", "sent", F.greatest(F.lit(0), oldest - F.col("read")).alias("missed"), (F.col("sent") - F.greatest("read", oldest)).alias("got"))


def relayed(*streams: DataFrame) -> DataFrame:
    """The union of nodes' events, each once."""
    whole = streams[0]
    for s in streams[1:]:
        whole = whole.unionByName(s)
    return whole.dropDuplicates(["event_id"])


def sse_payload(events: DataFrame) -> DataFrame:
    """``data``: the five fields that browsers get, as JSON."""
    return events.select(F.to_json(F.struct("event_id", "task_id", "queue_name", "new_status", "timestamp_ms")).alias("data"))


def parse_sse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from lines of an event stream; other lines and bad JSON are passed over."""
    schema = "event_id string, task_id string, queue_name string, new_status int, timestamp_ms bigint"
    data = lines.where(F.col(column).startswith("data: ")).select(F.from_json(F.substring(column, 7, 1 << 30), schema).alias("e"))
    return data.where("e.event_id IS NOT NULL").select("e.*")


def task_json(tasks: DataFrame) -> DataFrame:
    """``json`` of tasks as the REST interface shows them: no partition, times in RFC 3339."""
    plain = ["id", "queue_name", "task_name", "status", "priority", "max_retries", "attempt_count", "timeout_seconds", "idempotency_key", "input", "metadata", "output", "error_message"]
    times = ["scheduled_at", "created_at", "updated_at"]
    fields = [F.col(c) for c in plain if c in tasks.columns] + [rfc3339(F.col(c).cast("timestamp")).alias(c) for c in times if c in tasks.columns]
    return tasks.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def run_json(runs: DataFrame) -> DataFrame:
    times = {"lease_expires_at", "started_at", "completed_at", "last_heartbeat"}
    fields = [rfc3339(F.col(c).cast("timestamp")).alias(c) if c in times else F.col(c) for c in runs.columns]
    return runs.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def log_json(logs: DataFrame) -> DataFrame:
    """Without the time of insertion."""
    fields = [c for c in ("id", "task_run_id", "timestamp_ms", "level", "message", "metadata") if c in logs.columns]
    return logs.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def task_wire(tasks: DataFrame) -> DataFrame:
    """Tasks in wire form: nulls as empty strings, states as numbers."""
    texts = [c for c in ("input", "idempotency_key", "metadata", "output", "error_message") if c in tasks.columns]
    return tasks.withColumns({c: wire_text(F.col(c)) for c in texts} | {"status": status_code(F.col("status"))})


def log_wire(logs: DataFrame) -> DataFrame:
    return logs.withColumn("level", level_code(F.col("level")))


def log_lines(logs: DataFrame) -> DataFrame:
    """``line``: ``HH:MM:SS.mmm [LEVEL] message``."""
    at = F.date_format(F.timestamp_millis("timestamp_ms"), "HH:mm:ss.SSS")
    return logs.select("id", F.concat(at, F.lit(" ["), "level", F.lit("] "), "message").alias("line"))
