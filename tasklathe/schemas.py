"""Fixed schemas of the six tables and the event stream, their codes, and the snapshot that operators work on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# States and levels with their wire numbers.
TASK_STATUS = {"PENDING": 1, "DISPATCHING": 2, "RUNNING": 3, "COMPLETED": 4, "FAILED": 5, "RETRY": 6, "DEAD_LETTER": 7, "CANCELLED": 8}
LOG_LEVEL = {"DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4}
RUN_STATUS = ("RUNNING", "COMPLETED", "FAILED")
SIGNAL_STATUS = ("PENDING", "DELIVERED", "ACKNOWLEDGED")
TERMINAL = ("COMPLETED", "FAILED", "DEAD_LETTER", "CANCELLED")

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType(), "a": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """``name:kind`` items; kinds are s, i, l, t (timestamp), a (array of strings); a ``?`` marks a nullable column."""
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, _KINDS[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


# JSON columns are strings at rest; ``parse_json`` opens them where needed.
TASKS = _schema("id:s queue_name:s task_name:s partition_id:i status:s input:s? priority:i max_retries:i attempt_count:i timeout_seconds:i idempotency_key:s? metadata:s scheduled_at:t? created_at:t updated_at:t output:s? error_message:s?")
TASK_RUNS = _schema("id:s task_id:s attempt_number:i worker_id:s assigned_node_id:s status:s output:s? error_message:s? lease_expires_at:t started_at:t completed_at:t? last_heartbeat:t")
TASK_LOGS = _schema("id:l task_run_id:s timestamp_ms:l level:s message:s metadata:s? created_at:t")
DEAD_LETTERS = _schema("id:s task_id:s queue_name:s task_name:s input:s? error_message:s? attempt_count:i metadata:s created_at:t")
WORKERS = _schema("id:s name:s node_id:s queues:a concurrency:i status:s metadata:s last_heartbeat:t connected_at:t disconnected_at:t?")
SIGNALS = _schema("id:s task_id:s signal_name:s payload:s? status:s created_at:t delivered_at:t? acknowledged_at:t?")
EVENTS = _schema("event_id:s task_id:s queue_name:s previous_status:i new_status:i worker_id:s node_id:s attempt_number:i error_message:s timestamp_ms:l")

TABLES = {"tasks": TASKS, "runs": TASK_RUNS, "logs": TASK_LOGS, "dead_letters": DEAD_LETTERS, "workers": WORKERS, "signals": SIGNALS}


@dataclass(frozen=True)
class Snapshot:
    """The state of all tables at one time.  Transitions return a new one and leave this one alone."""

    tasks: DataFrame
    runs: DataFrame
    logs: DataFrame
    dead_letters: DataFrame
    workers: DataFrame
    signals: DataFrame

    def with_(self, **frames: DataFrame) -> Snapshot:
        return replace(self, **frames)


def empty(spark: SparkSession) -> Snapshot:
    return Snapshot(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})
