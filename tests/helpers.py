"""Hand-made rows for tests, with a fixed time."""

from datetime import datetime, timedelta

from tasklathe.schemas import DEAD_LETTERS, SIGNALS, TABLES, TASK_LOGS, TASK_RUNS, TASKS, WORKERS, Snapshot

AS_OF = "2024-05-01 12:00:00"
NOW = datetime(2024, 5, 1, 12)


def at(seconds):
    return NOW + timedelta(seconds=seconds)


def _rows(spark, schema, defaults, rows):
    full = [{**{f.name: None for f in schema.fields}, **defaults, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in full], schema)


TASK = {"queue_name": "default", "task_name": "t", "partition_id": 0, "status": "PENDING", "input": '{"key": "value"}', "priority": 0, "max_retries": 3, "attempt_count": 0, "timeout_seconds": 300, "metadata": "{}", "created_at": NOW, "updated_at": NOW}
RUN = {"attempt_number": 1, "worker_id": "w1", "assigned_node_id": "n1", "status": "RUNNING", "lease_expires_at": at(330), "started_at": NOW, "last_heartbeat": NOW}


def tasks(spark, *rows):
    return _rows(spark, TASKS, TASK, rows)


def runs(spark, *rows):
    return _rows(spark, TASK_RUNS, RUN, rows)


def logs(spark, *rows):
    return _rows(spark, TASK_LOGS, {"task_run_id": "r1", "timestamp_ms": 1000, "level": "INFO", "message": "m", "created_at": NOW}, rows)


def signals(spark, *rows):
    return _rows(spark, SIGNALS, {"task_id": "t1", "signal_name": "go", "status": "PENDING", "created_at": NOW}, rows)


def workers(spark, *rows):
    return _rows(spark, WORKERS, {"name": "w", "node_id": "n", "queues": ["q"], "concurrency": 1, "status": "ACTIVE", "metadata": "{}", "last_heartbeat": NOW, "connected_at": NOW}, rows)


def dead_letters(spark, *rows):
    return _rows(spark, DEAD_LETTERS, {"queue_name": "default", "task_name": "t", "attempt_count": 3, "metadata": "{}", "created_at": NOW}, rows)


def snapshot(spark, **frames):
    return Snapshot(**{name: frames.get(name, spark.createDataFrame([], schema)) for name, schema in TABLES.items()})


def by_id(frame, *columns):
    return {r["id"]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in frame.collect()}
