"""User task handlers, run in Arrow batches on the executors.

A handler takes a ``TaskContext`` and returns a JSON-serialisable value.  An error
is retryable unless it is a ``HandlerError`` that says otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import LOG_LEVEL

LEVELS = {name.lower(): code for name, code in LOG_LEVEL.items()}
RESULT = "run_id string, task_id string, success boolean, retryable boolean, output string, error_message string, logs array<struct<seq:int,level:int,message:string,metadata:string>>"


class HandlerError(Exception):
    def __init__(self, message: str, retryable: bool = True) -> None:
        super().__init__(message)
        self.retryable = retryable


class TaskContext:
    """What a handler sees of its task: its fields, its input, its signals, and a log."""

    def __init__(self, row: dict[str, Any]) -> None:
        self.task_id, self.run_id = row["task_id"], row["run_id"]
        self.queue_name, self.task_name = row.get("queue_name"), row.get("task_name")
        self.attempt_number = row.get("attempt_number")
        self._input, self.entries = row.get("input"), []
        self._signals = list(row.get("signals") if row.get("signals") is not None else [])

    def input(self) -> Any:
        """The input's JSON value; null or none is None, bad JSON is a ValueError."""
        return json.loads(self._input) if self._input else None

    def receive(self, name: str) -> Any:
        """The payload of the oldest signal of a name, or None; other signals stay."""
        for i, signal in enumerate(self._signals):
            if signal["signal_name"] == name:
                return self._signals.pop(i)["payload"]
        return None

    def log(self, level: str, message: str, metadata: Any = None) -> None:
        self.entries.append({"seq": len(self.entries), "level": LEVELS[level], "message": message, "metadata": None if metadata is None else json.dumps(metadata)})

    def debug(self, message: str) -> None:
        self.log("debug", message)

    def info(self, message: str) -> None:
        self.log("info", message)

    def warn(self, message: str) -> None:
        self.log("warn", message)

    def error(self, message: str) -> None:
        self.log("error", message)


def handle_one(handler: Callable[[TaskContext], Any], row: dict[str, Any]) -> dict[str, Any]:
    """A handler's result, whatever happens in it."""
    context = TaskContext(row)
    out = {"run_id": context.run_id, "task_id": context.task_id, "success": True, "retryable": False, "output": None, "error_message": None}
    try:
        out["output"] = json.dumps(handler(context))
    except Exception as e:  # noqa: BLE001  (user code)
        out |= {"success": False, "retryable": getattr(e, "retryable", True), "error_message": str(e)}
    return out | {"logs": context.entries}


def run_handlers(assignments: DataFrame, handler: Callable[[TaskContext], Any], at_once: int | None = None) -> DataFrame:
    """Results of running the handler on every assignment (``run_id``, ``task_id``, and what the context shows).

    A partition's handlers run one after another, so ``at_once`` partitions are so
    many handlers at a time at most.
    """
    if at_once is not None:
        assignments = assignments.repartition(at_once)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([handle_one(handler, r) for r in batch.to_dict("records")], columns=["run_id", "task_id", "success", "retryable", "output", "error_message", "logs"])

    return assignments.mapInPandas(run, RESULT)


def handler_logs(results: DataFrame) -> DataFrame:
    """Log entries of the results, one row each."""
    return results.select(F.col("run_id").alias("task_run_id"), F.inline("logs")).orderBy("task_run_id", "seq")
