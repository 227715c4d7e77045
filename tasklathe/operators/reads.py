"""Read queries: lookups, filtered and paged lists, top-k, keyset reads and queue analytics.

Sort keys always end in the row's id, so that ties have one order.  Optional
filters are added only where given, so that they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moment, status_name
from ..schemas import TASK_STATUS, TERMINAL

DEFAULT_PAGE = 50


def by_id(table: DataFrame, key: str) -> DataFrame:
    """The row of a key, or none."""
    return table.where(F.col("id") == key)


def where_equal(table: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal in every column whose wanted value isn't None."""
    for name, value in wanted.items():
        if value is not None:
            table = table.where(F.col(name) == value)
    return table


def status_filter(value: int | str | None) -> str | None:
    """A status to filter by: 0, unknown numbers and None mean no filter; a string is taken as it is, known or not."""
    if isinstance(value, int):
        return {v: k for k, v in TASK_STATUS.items()}.get(value)
    return value


def form_filter(value: str | None) -> str | None:
    """A filter from a form: empty and ``__all__`` mean none."""
    return None if value in (None, "", "__all__") else value


def list_tasks(tasks: DataFrame, queue: str | None = None, status: int | str | None = None, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """Newest tasks first."""
    found = where_equal(tasks, queue_name=queue, status=status_filter(status))
    return found.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def page_of_tasks(tasks: DataFrame, queue: str | None = None, status: int | str | None = None, size: int = DEFAULT_PAGE, token: str = "") -> tuple[DataFrame, str]:
    """A page and the next page's token, empty where this page isn't full.

    A token is an offset as text; one that can't be read is 0.
    """
    offset = int(token) if token.isdecimal() else 0
    page = list_tasks(tasks, queue, status, size, offset).collect()  # run once; ``size`` rows at most
    return tasks.sparkSession.createDataFrame(page, tasks.schema), str(offset + size) if len(page) == size else ""


def list_dead_letters(dead_letters: DataFrame, queue: str | None = None, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    return where_equal(dead_letters, queue_name=queue).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def runs_of(runs: DataFrame, task_id: str) -> DataFrame:
    """A task's runs, newest attempt first."""
    return runs.where(F.col("task_id") == task_id).orderBy(F.desc("attempt_number"), F.desc("id"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run of the highest attempt of every task; it keeps its nulls."""
    newest = Window.partitionBy("task_id").orderBy(F.desc("attempt_number"), F.desc("id"))
    return runs.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def latest_errors(runs: DataFrame) -> DataFrame:
    """``task_id``, ``error_message`` of every task's latest run, by a partial aggregate rather than a sort."""
    newest = F.max_by(F.struct("error_message"), F.struct("attempt_number", "id"))
    return runs.groupBy("task_id").agg(newest.alias("run")).select("task_id", F.col("run.error_message").alias("error_message"))


def signals_of(signals: DataFrame, task_id: str, status: str | None = None) -> DataFrame:
    """A task's signals, oldest first."""
    return where_equal(signals.where(F.col("task_id") == task_id), status=status).orderBy("created_at", "id")


def run_logs(logs: DataFrame, run_id: str, after_id: int | None = None, limit: int = 1000) -> DataFrame:
    """A run's log rows in time order, after a cursor on the row id.

    The cursor isn't the sort key: rows whose ids are out of time order can be
    passed over from one page to the next, as in the source system.
    """
    found = logs.where(F.col("task_run_id") == run_id)
    if after_id is not None:
        found = found.where(F.col("id") > after_id)
    return found.orderBy("timestamp_ms", "id").limit(limit)


def log_history(logs: DataFrame, run_id: str, include_history: bool = False, limit: int = 10_000) -> DataFrame:
    """What a log stream sends, and a relay between nodes: the history if it is asked for, and then it ends."""
    return run_logs(logs if include_history else logs.limit(0), run_id, limit=limit)


def recent(events: DataFrame, limit: int = 200, at: str = "timestamp_ms") -> DataFrame:
    """The newest events."""
    return events.orderBy(F.desc(at), F.desc("event_id")).limit(limit)


def list_workers(workers: DataFrame) -> DataFrame:
    """Workers at rest, latest connection first."""
    return workers.orderBy(F.desc("connected_at"), F.desc("id"))


def connected_workers(workers: DataFrame) -> DataFrame:
    """Live workers as an API shows them: ``active_tasks`` is an array of task ids and is counted."""
    return workers.select("id", "name", "node_id", "queues", "concurrency", F.size(F.array_distinct("active_tasks")).alias("active_tasks"), F.lit("CONNECTED").alias("status"), "last_heartbeat", "connected_at")


def is_eligible(as_of) -> Column:
    """Pending and due: a time equal to ``as_of`` is due."""
    return (F.col("status") == "PENDING") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= moment(as_of)))


def eligible(tasks: DataFrame, as_of) -> DataFrame:
    return tasks.where(is_eligible(as_of))


def expired_leases(runs: DataFrame, as_of) -> DataFrame:
    """Running runs whose lease ended before ``as_of``."""
    return runs.where((F.col("status") == "RUNNING") & (F.col("lease_expires_at") < moment(as_of)))


def due_retries(tasks: DataFrame, as_of) -> DataFrame:
    return tasks.where((F.col("status") == "RETRY") & (F.col("scheduled_at") <= moment(as_of)))


def unscheduled_retries(tasks: DataFrame) -> DataFrame:
    return tasks.where((F.col("status") == "RETRY") & F.col("scheduled_at").isNull())


def exhausted(tasks: DataFrame) -> DataFrame:
    """Failed tasks without attempts left."""
    return tasks.where((F.col("status") == "FAILED") & (F.col("attempt_count") >= F.col("max_retries")))


def orphans(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Dispatching tasks that no running run belongs to."""
    running = runs.where("status = 'RUNNING'").select(F.col("task_id").alias("id"))
    return tasks.where("status = 'DISPATCHING'").join(running, "id", "left_anti")


def accepts_signals(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("status").isin(*TERMINAL))


def split_signals(signals: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals to tasks that can take them, and rejected ones with a ``reason``: no such task, or a terminal one."""
    state = tasks.select(F.col("id").alias("task_id"), F.col("status").alias("__status"))
    told = signals.join(state, "task_id", "left")
    reason = F.when(F.col("__status").isNull(), "NOT_FOUND").when(F.col("__status").isin(*TERMINAL), "FAILED_PRECONDITION")
    told = told.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("__status", "reason"), told.where("reason IS NOT NULL").drop("__status")


def held_tasks(runs: DataFrame) -> DataFrame:
    """``worker_id``, ``task_id`` of running runs, each pair once."""
    return runs.where("status = 'RUNNING'").select("worker_id", "task_id").distinct()


def with_load(workers: DataFrame, held: DataFrame) -> DataFrame:
    """Workers with the number of tasks they hold, ``active_tasks``, and their ``free`` places."""
    load = held.groupBy(F.col("worker_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("active_tasks"))
    told = workers.join(load, "id", "left").withColumn("active_tasks", F.coalesce("active_tasks", F.lit(0)))
    return told.withColumn("free", F.col("concurrency") - F.col("active_tasks"))


def holders_of(held: DataFrame, task_ids: DataFrame) -> DataFrame:
    """``holders`` from pairs of worker and task."""
    return held.join(task_ids.select("task_id"), "task_id", "left_semi").groupBy("task_id").agg(F.min("worker_id").alias("worker_id"))


def holders(workers: DataFrame, task_ids: DataFrame) -> DataFrame:
    """``task_id``, ``worker_id``: the worker that has each task among its ``active_tasks``, the smallest id if several."""
    held = workers.select(F.col("id").alias("worker_id"), F.explode("active_tasks").alias("task_id"))
    return holders_of(held, task_ids)


def pending_by_queue(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'PENDING'").groupBy("queue_name").agg(F.count(F.lit(1)).alias("count"))


def queues(tasks: DataFrame) -> DataFrame:
    return tasks.select("queue_name").distinct()


def pending_with_zeros(tasks: DataFrame) -> DataFrame:
    """Pending tasks of every queue, drained ones with 0."""
    return tasks.groupBy("queue_name").agg(F.count_if(F.col("status") == "PENDING").alias("count"))


def _state_counts() -> list[Column]:
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "PENDING").alias("pending"),
        F.count_if(status == "RUNNING").alias("running"),
        F.count_if(status == "COMPLETED").alias("completed"),
        F.count_if(status.isin("FAILED", "DEAD_LETTER")).alias("failed"),
    ]


def queue_overview(tasks: DataFrame) -> DataFrame:
    """Tasks of every queue by state, busiest first.  States not listed count in the total only."""
    return tasks.groupBy("queue_name").agg(*_state_counts()).orderBy(F.desc("total"), "queue_name")


def queue_shares(tasks: DataFrame) -> DataFrame:
    """``queue_overview`` in percent of the queue's total."""
    share = [(F.col(c) / F.col("total") * 100).alias(f"{c}_pct") for c in ("pending", "running", "completed", "failed")]
    return tasks.groupBy("queue_name").agg(*_state_counts()).select("queue_name", *share)


def stats_cards(tasks: DataFrame, window: int = 500) -> DataFrame:
    """One row of state counts over the newest tasks."""
    return list_tasks(tasks, limit=window).agg(*_state_counts())


def worker_totals(workers: DataFrame) -> DataFrame:
    """``active_tasks`` (a number), ``concurrency`` and the number of workers, summed up."""
    return workers.agg(F.coalesce(F.sum("active_tasks"), F.lit(0)).alias("active_tasks"), F.coalesce(F.sum("concurrency"), F.lit(0)).alias("concurrency"), F.count(F.lit(1)).alias("workers"))


def free_slots(workers: DataFrame) -> DataFrame:
    """``free`` slots of workers whose ``active_tasks`` is an array; repeats in it count once."""
    return workers.withColumn("free", F.col("concurrency") - F.size(F.array_distinct("active_tasks")))


def decoded_events(events: DataFrame) -> DataFrame:
    return events.withColumn("status", status_name(F.col("new_status")))


def tasks_named(tasks: DataFrame, text: str | None = None, since=None, until=None) -> DataFrame:
    """Search by part of the name and time range (an extension: documented for the dashboard, not built there)."""
    if text:
        tasks = tasks.where(F.contains(F.lower("task_name"), F.lit(text.lower())))
    if since is not None:
        tasks = tasks.where(F.col("created_at") >= moment(since))
    if until is not None:
        tasks = tasks.where(F.col("created_at") < moment(until))
    return tasks


def throughput(runs: DataFrame, width: str = "1 day") -> DataFrame:
    """Runs completed by time window (an extension)."""
    span = F.window("completed_at", width)
    return runs.where("status = 'COMPLETED'").groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("completed")).select(F.col("w.start").alias("start"), "completed")
