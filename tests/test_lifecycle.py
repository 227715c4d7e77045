import pytest
from pyspark.sql import functions as F

from tasklathe.client import CODES, AlreadyExists, Client, FailedPrecondition, NotFound
from tasklathe.operators import transitions as T
from tasklathe.schemas import empty
from tasklathe.sources import config, store
from tasklathe.udf import HandlerError, run_handlers

from .helpers import by_id


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, queue_name string, task_name string, input string, idempotency_key string")


def step(client, handler):
    """Dequeue, dispatch to one worker, run the handler and apply its results."""
    snap, now = client.snapshot, client.as_of
    tasks, taken = T.dequeue(snap.tasks, now)
    given = taken.select(F.col("id").alias("task_id"), F.lit("w1").alias("worker_id"), F.lit("n1").alias("node_id"))
    tasks, new = T.checked_dispatch(tasks, snap.runs, given, now)
    runs = snap.runs.unionByName(new)
    todo = new.select(F.col("id").alias("run_id"), "task_id", "attempt_number").join(tasks.select(F.col("id").alias("task_id"), "input"), "task_id")
    tasks, runs = T.apply_results(tasks, runs, run_handlers(todo, handler).drop("logs"), now)
    return client._with(tasks=tasks, runs=runs)


def fixed(client):
    """The same client over materialised tables, so that plans stay short."""
    snap = client.snapshot
    return client._with(tasks=snap.tasks.checkpoint(), runs=snap.runs.checkpoint(), dead_letters=snap.dead_letters.checkpoint())


def test_create_retry_succeed_and_fail(spark):
    def work(context):
        if context.task_id == "bad":
            raise HandlerError("never", retryable=False)
        if context.task_id == "flaky" and context.attempt_number == 1:
            raise RuntimeError("once")
        return {"ok": context.input()["n"]}

    client = Client(empty(spark), "2024-05-01 12:00:00")
    client, rows = client.create_tasks(ask(spark, ("good", "q", "n", '{"n": 1}', "k1"), ("flaky", "q", "n", '{"n": 2}', None), ("bad", "q", "n", '{"n": 3}', None)))
    assert rows.count() == 3
    client = fixed(step(fixed(client), work))
    assert by_id(client.snapshot.tasks, "status", "attempt_count") == {"good": ("COMPLETED", 1), "flaky": ("RETRY", 1), "bad": ("FAILED", 1)}
    client = fixed(client.sweep())
    assert by_id(client.snapshot.tasks, "status")["flaky"] == "RETRY"
    client = fixed(client.at("2024-05-01 12:00:02").sweep())
    assert by_id(client.snapshot.tasks, "status")["flaky"] == "PENDING"
    client = fixed(step(client, work))
    assert by_id(client.snapshot.tasks, "status", "attempt_count", "output")["flaky"] == ("COMPLETED", 2, '{"ok":2}')
    assert [r.attempt_number for r in client.task_runs("flaky").collect()] == [2, 1]
    assert client.overview().first().total == 3


def test_client_errors(spark):
    client = Client(empty(spark), "2024-05-01 12:00:00")
    client, _ = client.create_tasks(ask(spark, ("a", "q", "n", None, "k")))
    client = fixed(client)
    with pytest.raises(AlreadyExists):
        client.create_tasks(ask(spark, ("b", "q", "n", None, "k")))
    with pytest.raises(NotFound):
        client.get_task("zz")
    client = client.send_signal("a", "go", '{"x": 1}')
    assert client.list_signals("a").count() == 1 and client.list_signals("a", "DELIVERED").count() == 0
    cancelled = client.cancel_task("a")
    with pytest.raises(FailedPrecondition):
        cancelled.cancel_task("a")
    with pytest.raises(FailedPrecondition):
        cancelled.send_signal("a", "go")
    gone, existed = client.delete_task("a")
    assert existed and gone.list_tasks().count() == 0 and gone.delete_task("a")[1] is False
    assert client.clear_all()[1] == 1 and client.health() == "ok" and client.pending().first()["count"] == 1
    assert CODES[NotFound] == (404, "NOT_FOUND")


def test_snapshots_at_rest(spark, tmp_path):
    client, _ = Client(empty(spark), "2024-05-01 12:00:00").create_tasks(ask(spark, ("a", "q", "n", None, "k")))
    store.write_snapshot(client.snapshot, str(tmp_path / "v1"))
    back = store.read_snapshot(spark, str(tmp_path / "v1"))
    assert by_id(back.tasks, "status", "idempotency_key") == {"a": ("PENDING", "k")} and back.runs.count() == 0
    store.register_views(back, "v_")
    assert spark.sql("SELECT count(*) FROM v_tasks WHERE status = 'PENDING'").first()[0] == 1


def test_config_layers(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text("[matching]\nnum_partitions = 8\nunknown = 1\n[scheduler]\nretry_base_delay_secs = 2\n")
    got = config.load(str(file), {"TASKLATHE_MATCHING__NUM_PARTITIONS": "12", "OTHER": "x"})
    assert (got.matching.num_partitions, got.matching.branching_factor, got.scheduler.retry_base_delay_secs) == (12, 3, 2)
    assert config.load(environ={}).log_ingester.batch_size == 100
