"""State transitions: pure functions from a snapshot to a new one and the rows that changed.

A guard decides which rows change; the others pass through as they are.  Time is
``as_of``.  One writer is assumed, so there are no row locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_text, lease_end, moment, plus_seconds, stable_id
from ..functions.scalar import HEARTBEAT_LEASE_SECONDS
from ..schemas import Snapshot
from .reads import eligible, orphans, where_equal

PARKED = ("PENDING", "RETRY")
OPEN = ("PENDING", "RETRY", "RUNNING", "DISPATCHING")


def updated(table: DataFrame, guard: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """The table with ``values`` set where ``guard`` holds, and the changed rows with their new values.

    Columns that the table doesn't have are left out.
    """
    values = {k: v for k, v in values.items() if k in table.columns}
    guard = F.coalesce(guard, F.lit(False))
    whole = table.select(*[F.when(guard, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
    changed = table.where(guard).select(*[values[c].cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns])
    return whole, changed


def _by_key(table: DataFrame, keys: DataFrame, key: str = "id", **values: Column) -> tuple[DataFrame, DataFrame]:
    """``updated`` for the rows whose key is in ``keys`` (one column of that name, without repeats)."""
    marked = table.join(keys.withColumn("__hit", F.lit(True)), key, "left").select(*[table[c] for c in table.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    whole, changed = updated(marked, F.col("__hit"), **values)
    return whole.drop("__hit"), changed.drop("__hit")


def set_status(tasks: DataFrame, task_id: str, status: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Any status to any other; there is no transition check."""
    return updated(tasks, F.col("id") == task_id, status=F.lit(status), updated_at=moment(as_of))


def increment_attempt(tasks: DataFrame, task_id: str, as_of) -> tuple[DataFrame, DataFrame]:
    return updated(tasks, F.col("id") == task_id, attempt_count=F.col("attempt_count") + 1, updated_at=moment(as_of))


def dequeue_choice(tasks: DataFrame, as_of, batch: int, queue: str | None = None, partition: int | None = None) -> DataFrame:
    """The next eligible tasks of each queue and partition: highest priority, then oldest."""
    due = eligible(where_equal(tasks, queue_name=queue), as_of)
    if partition is not None:
        due = due.where(F.col("partition_id") == partition)
    turn = Window.partitionBy("queue_name", "partition_id").orderBy(F.desc("priority"), "created_at", "id")
    return due.withColumn("__n", F.row_number().over(turn)).where(F.col("__n") <= batch).drop("__n")


def dequeue(tasks: DataFrame, as_of, batch: int = 50, queue: str | None = None, partition: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen tasks become DISPATCHING."""
    chosen = dequeue_choice(tasks, as_of, batch, queue, partition).select("id")
    return _by_key(tasks, chosen, status=F.lit("DISPATCHING"), updated_at=moment(as_of))


def cancel(tasks: DataFrame, task_id: str, as_of, running_too: bool = True) -> tuple[DataFrame, DataFrame]:
    """A task that is waiting, or with ``running_too`` on its way, becomes CANCELLED; its runs stay as they are."""
    states = OPEN if running_too else PARKED
    return updated(tasks, (F.col("id") == task_id) & F.col("status").isin(*states), status=F.lit("CANCELLED"), updated_at=moment(as_of))


def schedule_retry(tasks: DataFrame, task_id: str, when, as_of) -> tuple[DataFrame, DataFrame]:
    return updated(tasks, F.col("id") == task_id, status=F.lit("RETRY"), scheduled_at=moment(when), updated_at=moment(as_of))


def move_to_dead_letter(tasks: DataFrame, task_id: str, as_of) -> tuple[DataFrame, DataFrame]:
    return set_status(tasks, task_id, "DEAD_LETTER", as_of)


def promote_delayed(tasks: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Retries that are due become PENDING without a schedule."""
    guard = (F.col("status") == "RETRY") & (F.col("scheduled_at") <= moment(as_of))
    none = F.lit(None).cast(tasks.schema["scheduled_at"].dataType)
    return updated(tasks, guard, status=F.lit("PENDING"), scheduled_at=none, updated_at=moment(as_of))


def complete_task(tasks: DataFrame, task_id: str, output: str | None, as_of) -> tuple[DataFrame, DataFrame]:
    """An earlier error message stays."""
    return updated(tasks, F.col("id") == task_id, status=F.lit("COMPLETED"), output=F.lit(output), updated_at=moment(as_of))


def fail_task(tasks: DataFrame, task_id: str, error: str, as_of) -> tuple[DataFrame, DataFrame]:
    return updated(tasks, F.col("id") == task_id, status=F.lit("FAILED"), error_message=F.lit(error), updated_at=moment(as_of))


def complete_run(runs: DataFrame, run_id: str, output: str | None, as_of) -> tuple[DataFrame, DataFrame]:
    """Only a running run."""
    return updated(runs, (F.col("id") == run_id) & (F.col("status") == "RUNNING"), status=F.lit("COMPLETED"), output=F.lit(output), completed_at=moment(as_of))


def fail_run(runs: DataFrame, run_id: str, error: str, as_of) -> tuple[DataFrame, DataFrame]:
    return updated(runs, (F.col("id") == run_id) & (F.col("status") == "RUNNING"), status=F.lit("FAILED"), error_message=F.lit(error), completed_at=moment(as_of))


def heartbeat_run(runs: DataFrame, run_id: str, lease, as_of) -> tuple[DataFrame, DataFrame]:
    return updated(runs, (F.col("id") == run_id) & (F.col("status") == "RUNNING"), last_heartbeat=moment(as_of), lease_expires_at=moment(lease))


def heartbeat(runs: DataFrame, task_ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """All running runs of the tasks get a lease of a minute from now, even where theirs was longer."""
    keys = task_ids.select("task_id").distinct()
    hit = runs.join(keys.withColumn("__hit", F.lit(True)), "task_id", "left").select(*[runs[c] for c in runs.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    whole, changed = updated(hit, F.col("__hit") & (F.col("status") == "RUNNING"), last_heartbeat=moment(as_of), lease_expires_at=plus_seconds(moment(as_of), HEARTBEAT_LEASE_SECONDS))
    return whole.drop("__hit"), changed.drop("__hit")


def recover_orphans(tasks: DataFrame, runs: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Dispatching tasks without a running run go back to PENDING."""
    return _by_key(tasks, orphans(tasks, runs).select("id"), status=F.lit("PENDING"), updated_at=moment(as_of))


def delete_task(snapshot: Snapshot, task_ids: DataFrame) -> tuple[Snapshot, DataFrame]:
    """Tasks with their logs, runs, dead letters and signals; the second frame is the tasks that existed."""
    keys = task_ids.select("task_id").distinct()
    gone_runs = snapshot.runs.join(keys, "task_id", "left_semi").select(F.col("id").alias("task_run_id"))
    by_task = {name: getattr(snapshot, name).join(keys, "task_id", "left_anti").select(*getattr(snapshot, name).columns) for name in ("runs", "dead_letters", "signals")}
    logs = snapshot.logs.join(gone_runs, "task_run_id", "left_anti").select(*snapshot.logs.columns)
    own = keys.withColumnRenamed("task_id", "id")
    existed = snapshot.tasks.join(own, "id", "left_semi")
    tasks = snapshot.tasks.join(own, "id", "left_anti")
    return snapshot.with_(tasks=tasks, logs=logs, **by_task), existed


def clear_all(snapshot: Snapshot) -> tuple[Snapshot, DataFrame]:
    """No tasks, runs, logs, dead letters or signals; the second frame is the number of tasks that were there."""
    gone = {name: getattr(snapshot, name).limit(0) for name in ("tasks", "runs", "logs", "dead_letters", "signals")}
    return snapshot.with_(**gone), snapshot.tasks.agg(F.count(F.lit(1)).alias("deleted"))


def duplicate_attempts(runs: DataFrame, new_runs: DataFrame) -> DataFrame:
    """New runs whose task and attempt a run already has, or another new run."""
    taken = runs.select("task_id", "attempt_number").withColumn("__old", F.lit(1)).unionByName(new_runs.select("task_id", "attempt_number").withColumn("__old", F.lit(0)))
    twice = taken.groupBy("task_id", "attempt_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id", "attempt_number")
    return new_runs.join(twice, ["task_id", "attempt_number"], "left_semi")


def dispatch(tasks: DataFrame, assignments: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Assigned tasks (``task_id``, ``worker_id``, ``node_id``) start: RUNNING, one attempt more, and a run each.

    The second frame is the new runs, with a lease of timeout and half a minute.
    """
    at = moment(as_of)
    started = assignments.join(tasks.withColumnRenamed("id", "task_id"), "task_id")
    attempt = F.col("attempt_count") + 1
    runs = started.select(
        stable_id(F.col("task_id"), attempt.cast("string")).alias("id"), "task_id", attempt.alias("attempt_number"), "worker_id", F.col("node_id").alias("assigned_node_id"),
        F.lit("RUNNING").alias("status"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("error_message"),
        lease_end(at, F.col("timeout_seconds")).alias("lease_expires_at"), at.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), at.alias("last_heartbeat"),
    )
    keys = assignments.select(F.col("task_id").alias("id")).distinct()
    whole, _ = _by_key(tasks, keys, status=F.lit("RUNNING"), attempt_count=F.col("attempt_count") + 1, updated_at=at)
    return whole, runs


def checked_dispatch(tasks: DataFrame, runs: DataFrame, assignments: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """``dispatch`` without the assignments whose attempt exists already: those roll back whole."""
    _, planned = dispatch(tasks, assignments, as_of)
    refused = duplicate_attempts(runs, planned).select("task_id").distinct()
    return dispatch(tasks, assignments.join(refused, "task_id", "left_anti"), as_of)


def apply_results(tasks: DataFrame, runs: DataFrame, results: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Workers' results (``run_id``, ``task_id``, ``success``, ``retryable``, ``output``, ``error_message``).

    A success completes run and task; a retryable failure fails the run and sends
    the task to RETRY, its own error message unchanged; another failure fails
    both.  Runs change only while running.  Tasks change whatever their state, so
    a late result overrides a cancellation, and retries aren't counted here.
    Output that isn't JSON becomes null.  A task or run has one result at most.
    """
    at = moment(as_of)
    out = F.when(F.col("r_output") == "", F.lit(None)).otherwise(json_text(F.col("r_output")))
    told = results.select(F.col("run_id").alias("r_run"), F.col("task_id").alias("r_task"), F.col("success").alias("r_success"), F.col("retryable").alias("r_retryable"), F.col("output").alias("r_output"), F.col("error_message").alias("r_error"))
    ok, again = F.col("r_success"), ~F.col("r_success") & F.col("r_retryable")
    t = tasks.join(told, tasks["id"] == told["r_task"], "left")
    values = {
        "status": F.when(ok, "COMPLETED").when(again, "RETRY").otherwise("FAILED"),
        "output": F.when(ok, out).otherwise(F.col("output")) if "output" in tasks.columns else None,
        "error_message": F.when(ok | again, F.col("error_message")).otherwise(F.col("r_error")) if "error_message" in tasks.columns else None,
        "updated_at": at,
    }
    new_tasks, _ = updated(t, F.col("r_task").isNotNull(), **values)
    r = runs.join(told, runs["id"] == told["r_run"], "left")
    run_values = {
        "status": F.when(ok, "COMPLETED").otherwise("FAILED"),
        "output": F.when(ok, out).otherwise(F.col("output")) if "output" in runs.columns else None,
        "error_message": F.when(ok, F.col("error_message")).otherwise(F.col("r_error")),
        "completed_at": at,
    }
    new_runs, _ = updated(r, F.col("r_run").isNotNull() & (F.col("status") == "RUNNING"), **run_values)
    return new_tasks.select(*tasks.columns), new_runs.select(*runs.columns)


def deliver_signals(signals: DataFrame, ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Pending signals among ``ids`` become DELIVERED; others stay, so it can be repeated."""
    return _signal_step(signals, ids, "PENDING", "DELIVERED", delivered_at=moment(as_of))


def acknowledge_signals(signals: DataFrame, ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    return _signal_step(signals, ids, "DELIVERED", "ACKNOWLEDGED", acknowledged_at=moment(as_of))


def _signal_step(signals: DataFrame, ids: DataFrame, before: str, after: str, **values: Column) -> tuple[DataFrame, DataFrame]:
    keys = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    hit = signals.join(keys, "id", "left").select(*[signals[c] for c in signals.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    whole, changed = updated(hit, F.col("__hit") & (F.col("status") == before), status=F.lit(after), **values)
    return whole.drop("__hit"), changed.drop("__hit")


def reset_signals(signals: DataFrame, task_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivered signals of the tasks go back to PENDING (their worker is lost)."""
    keys = task_ids.select("task_id").distinct().withColumn("__hit", F.lit(True))
    hit = signals.join(keys, "task_id", "left").select(*[signals[c] for c in signals.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    none = F.lit(None).cast(signals.schema["delivered_at"].dataType)
    whole, changed = updated(hit, F.col("__hit") & (F.col("status") == "DELIVERED"), status=F.lit("PENDING"), delivered_at=none)
    return whole.drop("__hit"), changed.drop("__hit")


def reset_dispatching(tasks: DataFrame, ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Dispatching tasks for which no buffer had room go back to PENDING."""
    keys = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    hit = tasks.join(keys, "id", "left").select(*[tasks[c] for c in tasks.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    whole, changed = updated(hit, F.col("__hit") & (F.col("status") == "DISPATCHING"), status=F.lit("PENDING"), updated_at=moment(as_of))
    return whole.drop("__hit"), changed.drop("__hit")
