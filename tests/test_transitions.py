import pytest
from pyspark.sql import functions as F

from tasklathe.operators import inserts as I
from tasklathe.operators import sweeps as S
from tasklathe.operators import transitions as T

from .helpers import AS_OF, NOW, at, by_id, dead_letters, logs, runs, signals, snapshot, tasks


def keys(spark, *ids, name="id"):
    return spark.createDataFrame([(i,) for i in ids], f"{name} string")


def test_dequeue_takes_priority_then_age_per_partition(spark):
    t = tasks(spark, {"id": "low"}, {"id": "high", "priority": 10, "created_at": at(5)}, {"id": "old", "created_at": at(-5)}, {"id": "other", "partition_id": 1}, {"id": "later", "priority": 99, "scheduled_at": at(60)})
    whole, changed = T.dequeue(t, AS_OF, batch=2)
    assert sorted(by_id(changed, "status").items()) == [("high", "DISPATCHING"), ("old", "DISPATCHING"), ("other", "DISPATCHING")]
    assert by_id(whole, "status")["low"] == "PENDING" and whole.count() == 5
    assert by_id(T.dequeue(t, AS_OF, 1, "default", 0)[1], "id") == {"high": "high"}


def test_cancel_guards(spark):
    t = tasks(spark, {"id": "p"}, {"id": "r", "status": "RUNNING"}, {"id": "c", "status": "COMPLETED"})
    for key, any_, parked in (("p", 1, 1), ("r", 1, 0), ("c", 0, 0), ("zz", 0, 0)):
        assert T.cancel(t, key, AS_OF)[1].count() == any_
        assert T.cancel(t, key, AS_OF, running_too=False)[1].count() == parked


def test_promotion_clears_the_schedule(spark):
    t = tasks(spark, {"id": "due", "status": "RETRY", "scheduled_at": at(0)}, {"id": "not", "status": "RETRY", "scheduled_at": at(1)}, {"id": "unset", "status": "RETRY"})
    assert by_id(T.promote_delayed(t, AS_OF)[0], "status", "scheduled_at") == {"due": ("PENDING", None), "not": ("RETRY", at(1)), "unset": ("RETRY", None)}


def test_dispatch_and_duplicate_attempts(spark):
    t = tasks(spark, {"id": "a", "status": "DISPATCHING", "attempt_count": 1, "timeout_seconds": 60}, {"id": "b", "status": "DISPATCHING"})
    r = runs(spark, {"id": "x", "task_id": "b", "attempt_number": 1})
    given = spark.createDataFrame([("a", "w1", "n1"), ("b", "w2", "n1")], "task_id string, worker_id string, node_id string")
    whole, new = T.checked_dispatch(t, r, given, AS_OF)
    assert [(x.task_id, x.attempt_number, x.lease_expires_at) for x in new.collect()] == [("a", 2, at(90))]
    assert by_id(whole, "status", "attempt_count") == {"a": ("RUNNING", 2), "b": ("DISPATCHING", 0)}


RESULT = "run_id string, task_id string, success boolean, retryable boolean, output string, error_message string"


def test_results(spark):
    t = tasks(spark, *[{"id": k, "status": s, "error_message": "before"} for k, s in (("ok", "RUNNING"), ("again", "RUNNING"), ("dead", "RUNNING"), ("late", "CANCELLED"), ("bad", "RUNNING"), ("none", "RUNNING"))])
    r = runs(spark, *[{"id": f"r-{k}", "task_id": k, "status": "FAILED" if k == "late" else "RUNNING"} for k in ("ok", "again", "dead", "late", "bad", "none")])
    results = spark.createDataFrame([("r-ok", "ok", True, False, '{"a": 1}', ""), ("r-again", "again", False, True, "", "e1"), ("r-dead", "dead", False, False, "", "e2"), ("r-late", "late", True, False, "", ""), ("r-bad", "bad", True, False, "{bad", "")], RESULT)
    new_tasks, new_runs = T.apply_results(t, r, results, AS_OF)
    assert by_id(new_tasks, "status", "output", "error_message") == {
        "ok": ("COMPLETED", '{"a":1}', "before"), "again": ("RETRY", None, "before"), "dead": ("FAILED", None, "e2"), "late": ("COMPLETED", None, "before"), "bad": ("COMPLETED", None, "before"), "none": ("RUNNING", None, "before"),
    }
    assert by_id(new_runs, "status", "error_message") == {"r-ok": ("COMPLETED", None), "r-again": ("FAILED", "e1"), "r-dead": ("FAILED", "e2"), "r-late": ("FAILED", None), "r-bad": ("COMPLETED", None), "r-none": ("RUNNING", None)}


def test_heartbeat_can_shorten_a_lease(spark):
    r = runs(spark, {"id": "r", "task_id": "a", "lease_expires_at": at(330)}, {"id": "d", "task_id": "a", "status": "FAILED"}, {"id": "o", "task_id": "b"})
    whole, changed = T.heartbeat(r, keys(spark, "a", name="task_id"), AS_OF)
    assert by_id(changed, "lease_expires_at") == {"r": at(60)} and by_id(whole, "lease_expires_at")["o"] == at(330)
    assert by_id(T.heartbeat_run(r, "r", at(5), AS_OF)[1], "lease_expires_at") == {"r": at(5)}


def test_single_row_updates(spark):
    t, r = tasks(spark, {"id": "a", "status": "RUNNING", "error_message": "e"}), runs(spark, {"id": "r", "task_id": "a"}, {"id": "d", "task_id": "a", "status": "COMPLETED"})
    assert by_id(T.complete_task(t, "a", "{}", AS_OF)[0], "status", "output", "error_message") == {"a": ("COMPLETED", "{}", "e")}
    assert by_id(T.fail_task(t, "a", "x", AS_OF)[0], "status", "error_message") == {"a": ("FAILED", "x")}
    assert by_id(T.complete_run(r, "r", None, AS_OF)[0], "status") == {"r": "COMPLETED", "d": "COMPLETED"}
    assert T.fail_run(r, "d", "x", AS_OF)[1].count() == 0 and T.complete_run(r, "d", None, AS_OF)[1].count() == 0
    assert by_id(T.schedule_retry(t, "a", at(9), AS_OF)[0], "status", "scheduled_at") == {"a": ("RETRY", at(9))}
    assert by_id(T.move_to_dead_letter(t, "a", AS_OF)[0], "status") == {"a": "DEAD_LETTER"}
    assert by_id(T.increment_attempt(t, "a", AS_OF)[0], "attempt_count") == {"a": 1}


def test_signal_steps_repeat_safely(spark):
    s = signals(spark, {"id": "p"}, {"id": "d", "status": "DELIVERED", "delivered_at": NOW}, {"id": "a", "status": "ACKNOWLEDGED"})
    every = keys(spark, "p", "d", "a")
    once, changed = T.deliver_signals(s, every, AS_OF)
    assert by_id(changed, "status", "delivered_at") == {"p": ("DELIVERED", NOW)} and T.deliver_signals(once, every, AS_OF)[1].count() == 0
    assert by_id(T.acknowledge_signals(s, every, AS_OF)[1], "id") == {"d": "d"}
    assert by_id(T.reset_signals(s, keys(spark, "t1", name="task_id"))[1], "status", "delivered_at") == {"d": ("PENDING", None)}


def test_delete_cascades(spark):
    snap = snapshot(spark, tasks=tasks(spark, {"id": "a"}, {"id": "b"}), runs=runs(spark, {"id": "r1", "task_id": "a"}, {"id": "r2", "task_id": "b"}), logs=logs(spark, {"id": 1, "task_run_id": "r1"}, {"id": 2, "task_run_id": "r2"}), signals=signals(spark, {"id": "s", "task_id": "a"}), dead_letters=dead_letters(spark, {"id": "d", "task_id": "a"}))
    new, existed = T.delete_task(snap, keys(spark, "a", "zz", name="task_id"))
    assert {n: getattr(new, n).count() for n in ("tasks", "runs", "logs", "signals", "dead_letters")} == {"tasks": 1, "runs": 1, "logs": 1, "signals": 0, "dead_letters": 0}
    assert by_id(existed, "id") == {"a": "a"}
    gone, n = T.clear_all(snap)
    assert n.first()[0] == 2 and gone.tasks.count() == gone.logs.count() == 0


def test_buffer_reset(spark):
    t = tasks(spark, {"id": "a", "status": "DISPATCHING"}, {"id": "b", "status": "RUNNING"})
    assert by_id(T.reset_dispatching(t, keys(spark, "a", "b"), AS_OF)[0], "status") == {"a": "PENDING", "b": "RUNNING"}


def test_reap(spark):
    t = tasks(spark, {"id": "left", "status": "RUNNING", "attempt_count": 1}, {"id": "out", "status": "RUNNING", "attempt_count": 3}, {"id": "gone", "status": "CANCELLED", "attempt_count": 1}, {"id": "fine", "status": "RUNNING"})
    late = {"lease_expires_at": at(-60)}
    r = runs(spark, {"id": "1", "task_id": "left", **late}, {"id": "2", "task_id": "out", "attempt_number": 2, **late}, {"id": "3", "task_id": "out", "attempt_number": 3, **late}, {"id": "4", "task_id": "gone", **late}, {"id": "5", "task_id": "fine"}, {"id": "6", "task_id": "unknown", **late})
    new_tasks, new_runs, dead = S.reap(t, r, AS_OF)
    assert by_id(new_tasks, "status") == {"left": "RETRY", "out": "DEAD_LETTER", "gone": "RETRY", "fine": "RUNNING"}
    assert {k for k, v in by_id(new_runs, "status").items() if v == "FAILED"} == {"1", "2", "3", "4", "6"}
    assert [(d.task_id, d.error_message) for d in dead.collect()] == [("out", "Lease expired")] * 2 and len(set(by_id(dead, "id"))) == 2


def test_retry_schedule_grows_and_skips_scheduled(spark):
    t = tasks(spark, {"id": "a", "status": "RETRY", "attempt_count": 0}, {"id": "b", "status": "RETRY", "attempt_count": 3}, {"id": "c", "status": "RETRY", "scheduled_at": at(7)}, {"id": "d"})
    assert by_id(S.schedule_retries(t, AS_OF)[0], "scheduled_at") == {"a": at(1), "b": at(8), "c": at(7), "d": None}
    assert by_id(S.schedule_retries(t, AS_OF, limit=1)[1], "scheduled_at") == {"a": at(1)}


def test_exhausted_are_buried(spark):
    t = tasks(spark, {"id": "a", "status": "FAILED", "attempt_count": 3}, {"id": "b", "status": "FAILED", "attempt_count": 0}, {"id": "c", "status": "FAILED", "attempt_count": 4})
    r = runs(spark, {"id": "1", "task_id": "a", "error_message": "old"}, {"id": "2", "task_id": "a", "attempt_number": 2})
    whole, dead = S.bury_exhausted(t, r, AS_OF)
    assert by_id(whole, "status") == {"a": "DEAD_LETTER", "b": "FAILED", "c": "DEAD_LETTER"}
    assert {d.task_id: d.error_message for d in dead.collect()} == {"a": None, "c": None}
    assert S.bury_exhausted(t, r, AS_OF, limit=1)[1].count() == 1


def test_whole_sweep(spark):
    t = tasks(spark, {"id": "a", "status": "RUNNING", "attempt_count": 1}, {"id": "b", "status": "RETRY", "scheduled_at": at(-1)}, {"id": "c", "status": "FAILED", "attempt_count": 3})
    new = S.sweep(snapshot(spark, tasks=t, runs=runs(spark, {"id": "1", "task_id": "a", "lease_expires_at": at(-1)})), AS_OF)
    assert by_id(new.tasks, "status", "scheduled_at") == {"a": ("RETRY", at(2)), "b": ("PENDING", None), "c": ("DEAD_LETTER", None)}
    assert new.dead_letters.count() == 1


def test_insert_defaults_and_idempotency(spark):
    asked = spark.createDataFrame([("1", "q", "n", None, 0), ("2", "q", "n", "k", 5), ("3", "p", "n", "k", None), ("4", "q", "n", "taken", None), ("5", "q", "n", None, None)], "id string, queue_name string, task_name string, idempotency_key string, max_retries int")
    rows = I.new_tasks(asked, AS_OF, zero_is_unset=True)
    assert by_id(rows, "max_retries", "timeout_seconds", "priority", "metadata", "status") == {k: (n, 300, 0, "{}", "PENDING") for k, n in (("1", 3), ("2", 5), ("3", 3), ("4", 3), ("5", 3))}
    assert by_id(I.new_tasks(asked, AS_OF), "max_retries")["1"] == 0
    assert all(0 <= p < 4 for p in by_id(rows, "partition_id").values())
    whole, refused = I.insert_tasks(tasks(spark, {"id": "0", "idempotency_key": "taken"}), rows)
    assert set(by_id(whole, "id")) == {"0", "1", "2", "5"} and set(by_id(refused, "id")) == {"3", "4"}


def test_log_batches(spark):
    batches = spark.createDataFrame([(1, ["r", "r"], [1000, 1001], ["INFO", "LOUD"], ["a", "b"], ['{"x": 1}', "{bad"]), (2, [], [], [], [], []), (3, ["s"], [5], ["ERROR"], ["c"], [None])], "batch_id int, task_run_id array<string>, timestamp_ms array<long>, level array<string>, message array<string>, metadata array<string>")
    got = I.log_rows(batches, AS_OF, first_id=10).orderBy("id").collect()
    assert [(r.id, r.task_run_id, r.level, r.message, r.metadata) for r in got] == [(10, "r", "INFO", "a", '{"x":1}'), (11, "r", "INFO", "b", None), (12, "s", "ERROR", "c", None)]


def test_new_signals(spark):
    asked = spark.createDataFrame([("t", "go", '{"a": 1}', 0), ("t", "go", '{"a": 1}', 1)], "task_id string, signal_name string, payload string, seq int")
    got = I.new_signals(asked, AS_OF)
    assert len(by_id(got, "id")) == 2 and {r.status for r in got.collect()} == {"PENDING"}


@pytest.mark.parametrize("name", ["updated"])
def test_unknown_columns_are_left_out(spark, name):
    frame = spark.createDataFrame([("a", "X")], "id string, status string")
    whole, _ = getattr(T, name)(frame, F.lit(True), status=F.lit("Y"), missing=F.lit(1))
    assert [tuple(r) for r in whole.collect()] == [("a", "Y")]
