from pyspark.sql import functions as F

from tasklathe.operators import reads as R

from .helpers import AS_OF, at, by_id, dead_letters, logs, runs, signals, tasks


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_lists_filter_page_and_break_ties(spark):
    t = tasks(spark, *[{"id": f"t{i}", "created_at": at(i // 2), "queue_name": "ab"[i % 2], "status": ("PENDING", "FAILED")[i % 3 == 0]} for i in range(6)])
    assert ids(R.list_tasks(t)) == ["t5", "t4", "t3", "t2", "t1", "t0"]
    assert ids(R.list_tasks(t, queue="a", status="FAILED")) == ["t0"]
    assert ids(R.list_tasks(t, status=5)) == ["t3", "t0"]
    assert len(ids(R.list_tasks(t, status=0))) == 6 and ids(R.list_tasks(t, status="failed")) == []
    page, token = R.page_of_tasks(t, size=4)
    assert (ids(page), token) == (["t5", "t4", "t3", "t2"], "4")
    page, token = R.page_of_tasks(t, size=4, token=token)
    assert (ids(page), token) == (["t1", "t0"], "")
    assert ids(R.page_of_tasks(t, size=1, token="zzz")[0]) == ["t5"]
    assert R.form_filter("__all__") is R.form_filter("") is None and R.form_filter("x") == "x"


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    tasks(spark, {"id": "a"}).write.parquet(path)
    plan = R.list_tasks(spark.read.parquet(path), queue="a").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(queue_name,a)" in plan and "TakeOrderedAndProject" in plan and "priority" not in plan.split("ReadSchema")[1]


def test_eligibility_is_inclusive_and_leases_strict(spark):
    t = tasks(spark, {"id": "past", "scheduled_at": at(-10)}, {"id": "now", "scheduled_at": at(0)}, {"id": "later", "scheduled_at": at(3600)}, {"id": "none"}, {"id": "run", "status": "RUNNING"})
    assert sorted(ids(R.eligible(t, AS_OF))) == ["none", "now", "past"]
    r = runs(spark, {"id": "at", "task_id": "a", "lease_expires_at": at(0)}, {"id": "gone", "task_id": "a", "lease_expires_at": at(-1)}, {"id": "done", "task_id": "a", "status": "FAILED", "lease_expires_at": at(-9)})
    assert ids(R.expired_leases(r, AS_OF)) == ["gone"]


def test_latest_run_keeps_its_null_error(spark):
    r = runs(spark, {"id": "r1", "task_id": "a", "attempt_number": 1, "error_message": "old"}, {"id": "r2", "task_id": "a", "attempt_number": 2}, {"id": "r3", "task_id": "b", "error_message": "b"})
    assert sorted(ids(R.latest_runs(r))) == ["r2", "r3"]
    assert {x.task_id: x.error_message for x in R.latest_errors(r).collect()} == {"a": None, "b": "b"}
    assert ids(R.runs_of(r, "a")) == ["r2", "r1"]


def test_log_cursor_is_not_the_sort_key(spark):
    rows = logs(spark, {"id": 3, "timestamp_ms": 10}, {"id": 1, "timestamp_ms": 20}, {"id": 2, "timestamp_ms": 30}, {"id": 9, "task_run_id": "other"})
    assert ids(R.run_logs(rows, "r1")) == [3, 1, 2]
    assert ids(R.run_logs(rows, "r1", limit=1)) == [3]
    assert ids(R.run_logs(rows, "r1", after_id=3)) == []
    assert ids(R.run_logs(rows, "r1", after_id=1)) == [3, 2]


def test_orphans_and_signals(spark):
    t = tasks(spark, {"id": "a", "status": "DISPATCHING"}, {"id": "b", "status": "DISPATCHING"}, {"id": "c", "status": "CANCELLED"})
    r = runs(spark, {"id": "r", "task_id": "a"}, {"id": "s", "task_id": "b", "status": "FAILED"})
    assert ids(R.orphans(t, r)) == ["b"]
    s = signals(spark, {"id": "1", "task_id": "a", "created_at": at(2)}, {"id": "2", "task_id": "a", "created_at": at(1), "status": "DELIVERED"}, {"id": "3", "task_id": "c"}, {"id": "4", "task_id": "zz"})
    assert ids(R.signals_of(s, "a")) == ["2", "1"] and ids(R.signals_of(s, "a", "PENDING")) == ["1"]
    good, bad = R.split_signals(s, t)
    assert sorted(ids(good)) == ["1", "2"] and by_id(bad, "reason") == {"3": "FAILED_PRECONDITION", "4": "NOT_FOUND"}


def test_overview_and_cards(spark):
    states = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "DEAD_LETTER", "RETRY"]
    t = tasks(spark, *[{"id": f"{i}", "queue_name": "a", "status": s, "created_at": at(i)} for i, s in enumerate(states)], {"id": "x", "queue_name": "b"})
    assert [tuple(r) for r in R.queue_overview(t).collect()] == [("a", 6, 1, 1, 1, 2), ("b", 1, 1, 0, 0, 0)]
    assert tuple(R.stats_cards(t, window=2).first()) == (2, 0, 0, 0, 1)
    assert {r.queue_name: r["count"] for r in R.pending_with_zeros(t.where("id <> 'x' AND id <> '0'")).collect()} == {"a": 0}
    assert R.queue_overview(t.limit(0)).count() == 0


def test_workers(spark):
    w = spark.createDataFrame([("w1", 3, ["a", "b", "a"]), ("w2", 1, []), ("w0", 2, ["b"])], "id string, concurrency int, active_tasks array<string>")
    assert by_id(R.free_slots(w), "free") == {"w1": 1, "w2": 1, "w0": 1}
    assert tuple(R.worker_totals(w.withColumn("active_tasks", F.size("active_tasks"))).first()) == (4, 6, 3)
    wanted = spark.createDataFrame([("b",), ("zz",)], "task_id string")
    assert [tuple(r) for r in R.holders(w, wanted).collect()] == [("b", "w0")]


def test_dead_letters_by_queue(spark):
    d = dead_letters(spark, {"id": "1", "task_id": "a", "created_at": at(1)}, {"id": "2", "task_id": "a", "created_at": at(2)}, {"id": "3", "task_id": "a", "queue_name": "z"})
    assert ids(R.list_dead_letters(d, "default")) == ["2", "1"] and ids(R.list_dead_letters(d, limit=1)) == ["2"]
