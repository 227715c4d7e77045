"""A client over a snapshot: the calls of the service as methods that return frames.

Writing calls return a new client; the old one still shows the old state.  Every
call takes its time from ``as_of``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import inserts, reads, sweeps, transitions
from .schemas import Snapshot


class AlreadyExists(Exception):
    """An idempotency key is taken."""


class NotFound(Exception):
    """No such row."""


class FailedPrecondition(Exception):
    """The row's state doesn't allow it."""


#: HTTP and RPC codes of errors.
CODES = {AlreadyExists: (409, "ALREADY_EXISTS"), NotFound: (404, "NOT_FOUND"), FailedPrecondition: (412, "FAILED_PRECONDITION"), ValueError: (400, "INVALID_ARGUMENT")}


@dataclass(frozen=True)
class Client:
    snapshot: Snapshot
    as_of: str
    partitions: int = 4

    def at(self, as_of: str) -> Client:
        return replace(self, as_of=as_of)

    def _with(self, **frames: DataFrame) -> Client:
        return replace(self, snapshot=self.snapshot.with_(**frames))

    def _one(self, task_id: str):
        row = reads.by_id(self.snapshot.tasks, task_id).first()
        if row is None:
            raise NotFound(f"task {task_id}")
        return row

    def create_tasks(self, requests: DataFrame) -> tuple[Client, DataFrame]:
        """Insert tasks; raises where a key is taken, and then nothing is inserted."""
        rows = inserts.new_tasks(requests, self.as_of, self.partitions)
        tasks, refused = inserts.insert_tasks(self.snapshot.tasks, rows)
        if not refused.isEmpty():
            raise AlreadyExists("idempotency key")
        return self._with(tasks=tasks), rows

    def get_task(self, task_id: str) -> DataFrame:
        self._one(task_id)
        return reads.by_id(self.snapshot.tasks, task_id)

    def list_tasks(self, queue: str | None = None, status: int | str | None = None, limit: int = reads.DEFAULT_PAGE, offset: int = 0) -> DataFrame:
        return reads.list_tasks(self.snapshot.tasks, queue, status, limit, offset)

    def cancel_task(self, task_id: str) -> Client:
        self._one(task_id)
        tasks, changed = transitions.cancel(self.snapshot.tasks, task_id, self.as_of)
        if changed.isEmpty():
            raise FailedPrecondition(f"task {task_id} can't be cancelled")
        return self._with(tasks=tasks)

    def task_runs(self, task_id: str) -> DataFrame:
        return reads.runs_of(self.snapshot.runs, task_id)

    def run_logs(self, run_id: str, after_id: int | None = None, limit: int = 1000) -> DataFrame:
        return reads.run_logs(self.snapshot.logs, run_id, after_id, limit)

    def list_workers(self) -> DataFrame:
        return reads.list_workers(self.snapshot.workers)

    def list_dead_letters(self, queue: str | None = None, limit: int = reads.DEFAULT_PAGE, offset: int = 0) -> DataFrame:
        return reads.list_dead_letters(self.snapshot.dead_letters, queue, limit, offset)

    def send_signal(self, task_id: str, name: str, payload: str | None = None, seq: int = 0) -> Client:
        if self._one(task_id)["status"] in reads.TERMINAL:
            raise FailedPrecondition(f"task {task_id} has ended")
        spark = self.snapshot.tasks.sparkSession
        request = spark.createDataFrame([(task_id, name, payload, seq)], "task_id string, signal_name string, payload string, seq int")
        return self._with(signals=self.snapshot.signals.unionByName(inserts.new_signals(request, self.as_of)))

    def list_signals(self, task_id: str, status: str | None = None) -> DataFrame:
        self._one(task_id)
        return reads.signals_of(self.snapshot.signals, task_id, status)

    def delete_task(self, task_id: str) -> tuple[Client, bool]:
        ids = self.snapshot.tasks.sparkSession.createDataFrame([(task_id,)], "task_id string")
        snapshot, existed = transitions.delete_task(self.snapshot, ids)
        return replace(self, snapshot=snapshot), not existed.isEmpty()

    def clear_all(self) -> tuple[Client, int]:
        snapshot, gone = transitions.clear_all(self.snapshot)
        return replace(self, snapshot=snapshot), gone.first()[0]

    def sweep(self) -> Client:
        return replace(self, snapshot=sweeps.sweep(self.snapshot, self.as_of))

    def health(self) -> str:
        return "ok"

    def overview(self) -> DataFrame:
        return reads.queue_overview(self.snapshot.tasks)

    def pending(self) -> DataFrame:
        return reads.pending_by_queue(self.snapshot.tasks).orderBy(F.desc("count"))
