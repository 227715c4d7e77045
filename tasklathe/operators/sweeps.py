"""Scheduler sweeps over a snapshot: leases, retries, dead letters, delayed tasks.

The source runs them on independent timers; here one order is fixed: reap, retry,
dead-letter, promote.  Row-by-row lookups are joins, and batches are whole unless
``limit`` is given (then the smallest ids come first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import backoff_seconds, moment, plus_seconds, stable_id
from ..schemas import Snapshot
from . import reads
from .transitions import promote_delayed, updated

LEASE_ERROR = "Lease expired"


def dead_letter_rows(tasks: DataFrame, as_of, key: str = "id") -> DataFrame:
    """Dead letters of tasks that have an ``error`` column; ``key`` tells several of one task apart."""
    have = lambda c: (F.col(c) if c in tasks.columns else F.lit(None).cast("string")).alias(c)
    return tasks.select(
        stable_id(F.lit("dead"), F.col("id"), F.col(key)).alias("id"), F.col("id").alias("task_id"), "queue_name", "task_name", have("input"),
        F.col("error").alias("error_message"), "attempt_count", F.coalesce(have("metadata"), F.lit("{}")).alias("metadata"), moment(as_of).alias("created_at"),
    )


def reap(tasks: DataFrame, runs: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks, runs and new dead letters after all expired leases are handled.

    An expired run fails.  Its task goes to RETRY if it has attempts left, else
    to DEAD_LETTER with a row for each expired run; the task's own state isn't
    looked at, so a cancelled one can come back.  Runs of unknown tasks only
    fail.  The dead letter carries the latest run's error, the expired ones
    counted as failed.
    """
    at = moment(as_of)
    guard = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") < at)
    new_runs, expired = updated(runs, guard, status=F.lit("FAILED"), error_message=F.lit(LEASE_ERROR), completed_at=at)
    hit = expired.select(F.col("task_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    told = tasks.join(hit, "id", "left").select(*[tasks[c] for c in tasks.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    left = F.col("attempt_count") < F.col("max_retries")
    new_tasks, _ = updated(told, F.col("__hit"), status=F.when(left, "RETRY").otherwise("DEAD_LETTER"), updated_at=at)
    errors = reads.latest_errors(new_runs).select(F.col("task_id").alias("id"), F.col("error_message").alias("error"))
    lost = expired.select(F.col("task_id").alias("id"), F.col("id").alias("run_id")).join(tasks.where(~left), "id")
    dead = lost.select("run_id", *tasks.columns).join(errors, "id", "left")
    return new_tasks.drop("__hit"), new_runs, dead_letter_rows(dead, as_of, key="run_id")


def schedule_retries(tasks: DataFrame, as_of, base: int = 1, cap: int = 3600, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Retries without a time get one: ``as_of`` plus the backoff of their attempts."""
    at = moment(as_of)
    guard = (F.col("status") == "RETRY") & F.col("scheduled_at").isNull()
    values = {"scheduled_at": plus_seconds(at, backoff_seconds(F.col("attempt_count"), base, cap)), "updated_at": at}
    if limit is None:
        return updated(tasks, guard, **values)
    some = tasks.where(guard).orderBy("id").limit(limit).select("id").withColumn("__hit", F.lit(True))
    told = tasks.join(some, "id", "left").select(*[tasks[c] for c in tasks.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    whole, changed = updated(told, F.col("__hit"), **values)
    return whole.drop("__hit"), changed.drop("__hit")


def bury_exhausted(tasks: DataFrame, runs: DataFrame, as_of, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Failed tasks without attempts left become DEAD_LETTER; the second frame is their dead letters, with the latest run's error.

    Failed tasks that have attempts left stay as they are.
    """
    at = moment(as_of)
    done = reads.exhausted(tasks)
    if limit is not None:
        done = done.orderBy("id").limit(limit)
    errors = reads.latest_errors(runs).select(F.col("task_id").alias("id"), F.col("error_message").alias("error"))
    dead = dead_letter_rows(done.drop("error").join(errors, "id", "left"), as_of)
    hit = done.select("id").withColumn("__hit", F.lit(True))
    told = tasks.join(hit, "id", "left").select(*[tasks[c] for c in tasks.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    whole, _ = updated(told, F.col("__hit"), status=F.lit("DEAD_LETTER"), updated_at=at)
    return whole.drop("__hit"), dead


def sweep(snapshot: Snapshot, as_of, base: int = 1, cap: int = 3600) -> Snapshot:
    """One round of all sweeps."""
    tasks, runs, dead = reap(snapshot.tasks, snapshot.runs, as_of)
    tasks, _ = schedule_retries(tasks, as_of, base, cap)
    tasks, more = bury_exhausted(tasks, runs, as_of)
    tasks, _ = promote_delayed(tasks, as_of)
    letters = snapshot.dead_letters.unionByName(dead, allowMissingColumns=True).unionByName(more, allowMissingColumns=True)
    return snapshot.with_(tasks=tasks, runs=runs, dead_letters=letters)


def sweep_counts(tasks: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """How many rows each sweep would handle, each on the tables as they are."""
    expired = reads.expired_leases(runs, as_of).agg(F.count(F.lit(1)).alias("reaped"))
    states = tasks.agg(
        F.count_if((F.col("status") == "RETRY") & F.col("scheduled_at").isNull()).alias("retried"),
        F.count_if((F.col("status") == "FAILED") & (F.col("attempt_count") >= F.col("max_retries"))).alias("dead_lettered"),
        F.count_if((F.col("status") == "RETRY") & (F.col("scheduled_at") <= moment(as_of))).alias("promoted"),
    )
    return expired.withColumn("one", F.lit(1)).join(states.withColumn("one", F.lit(1)), "one").drop("one")
