import json

import pytest
from pyspark.sql import functions as F

from tasklathe.operators import events as E
from tasklathe.streaming import pipelines as P
from tasklathe.streaming import stateful as St
from tasklathe.udf import HandlerError, handler_logs, run_handlers

from .helpers import AS_OF, at, tasks


def event(i, **more):
    return {"event_id": str(i), "task_id": f"t{i}", "queue_name": "q", "previous_status": 0, "new_status": 1, "worker_id": "", "node_id": "", "attempt_number": 0, "error_message": "", "timestamp_ms": 1714564800000 + i * 1000} | more


def save(spark, path, rows):
    from tasklathe.schemas import EVENTS

    spark.createDataFrame([tuple(r[f.name] for f in EVENTS.fields) for r in rows], EVENTS).write.mode("append").parquet(path)


def drain(frame, tmp_path, mode="append", name="out"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_relay_is_once_only(spark, tmp_path):
    path = str(tmp_path / "e")
    save(spark, path, [event(1), event(2, node_id="n1"), event(3, node_id="n2"), event(1)])
    got = drain(P.relay_stream(P.event_stream(spark, path), "n1"), tmp_path, name="relay")
    assert sorted(r.event_id for r in got.collect()) == ["1", "2"]


def test_counters_and_filter(spark, tmp_path):
    path = str(tmp_path / "e")
    save(spark, path, [event(1), event(2, new_status=4), event(3, queue_name="z")])
    got = drain(P.counters(P.event_stream(spark, path)), tmp_path, "complete", "counters")
    assert {(r.metric, r.queue_name): r.value for r in got.collect()}[("tasks_completed_total", "")] == 1
    assert P.for_queue(spark.read.parquet(path), "z").count() == 1 and P.for_queue(spark.read.parquet(path)).count() == 3


def test_windows_close_by_watermark(spark, tmp_path):
    path = str(tmp_path / "e")
    save(spark, path, [event(1), event(2), event(4000)])
    got = drain(P.counters_by_window(P.event_stream(spark, path)), tmp_path, name="windows")
    assert [r.n for r in got.collect()] == [2]


def test_log_ingestion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"task_run_id": "r", "timestamp_ms": 1, "level": 3, "message": "m", "metadata": '{"a": 1}'}, {"task_run_id": "r", "timestamp_ms": 2, "level": 9, "message": "n", "metadata": "{bad"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    out = str(tmp_path / "out")
    P.ingest_logs(P.log_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "ck"), interval=None).awaitTermination(120)
    assert [(r.level, r.metadata) for r in spark.read.parquet(out).orderBy("timestamp_ms").collect()] == [("WARN", '{"a":1}'), ("INFO", None)]


def test_recent_list_is_merged(spark, tmp_path):
    path, kept = str(tmp_path / "e"), []
    save(spark, path, [event(i) for i in range(5)])
    load = lambda: spark.createDataFrame(kept) if kept else None

    def store(frame):
        kept[:] = frame.select("event_id", "timestamp_ms").collect()

    events = P.event_stream(spark, path).select("event_id", "timestamp_ms")
    for more in ([], [event(9)]):
        if more:
            save(spark, path, more)
        P.keep_recent(events, store, load, str(tmp_path / "ck"), limit=3).awaitTermination(120)
    assert [r.event_id for r in kept] == ["9", "4", "3"]


def test_liveness(spark):
    last = P.last_heartbeats(spark.createDataFrame([("a", at(-5)), ("a", at(-40)), ("b", at(-11)), ("c", at(-31))], "worker_id string, ts timestamp"))
    assert {r.worker_id: r.liveness for r in P.liveness_at(last, AS_OF).collect()} == {"a": "Alive", "b": "Suspect", "c": "Dead"}


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", St.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_signal_inbox(rocks, tmp_path):
    schema = "task_id string, seq int, kind string, signal_name string, payload string"
    rows = [("t", 1, "send", "b", "1"), ("t", 2, "send", "a", "2"), ("t", 3, "send", "a", "3"), ("t", 4, "receive", "a", None), ("t", 5, "receive", "c", None), ("u", 1, "receive", "a", None)]
    rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = rocks.readStream.schema(schema).parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in drain(St.received_signals(stream), tmp_path, "append", "inbox").collect()] == [("t", "a", "2")]


def test_signal_inbox_receive_before_its_signal(rocks, tmp_path):
    schema = "task_id string, seq int, kind string, signal_name string, payload string"
    path = str(tmp_path / "w")
    for rows in ([("t", 1, "receive", "a", None), ("t", 2, "receive", "b", None)], [("t", 3, "send", "b", "1"), ("t", 4, "send", "b", "2")], [("t", 5, "send", "a", "3"), ("t", 6, "receive", "b", None)]):
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(tuple(r) for r in drain(St.received_signals(stream), tmp_path, "append", "early").collect()) == [("t", "a", "3"), ("t", "b", "1"), ("t", "b", "2")]


def test_lease_timers_old_rows_change_nothing(rocks, tmp_path):
    schema = "run_id string, ts timestamp, lease_ends timestamp"
    path = str(tmp_path / "o")
    batches = [[("kept", at(20), at(5000)), ("done", at(5), None), ("late", at(0), at(30))], [("kept", at(0), at(30)), ("done", at(4), at(30)), ("done", at(6), at(31))], [("tick", at(1000), at(9000))], [("tick", at(1100), at(9000))], [("late", at(1101), at(2000)), ("tick", at(3000), at(9000))], [("tick", at(3100), at(9000))]]
    for rows in batches:
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(St.expired_lease_stream(stream, "60 seconds"), tmp_path, "append", "old")
    assert [r.run_id for r in got.collect()] == ["late"]


def test_lease_timers(rocks, tmp_path):
    schema = "run_id string, ts timestamp, lease_ends timestamp"
    rows = [("late", at(0), at(30)), ("kept", at(0), at(30)), ("kept", at(20), at(5000)), ("done", at(0), at(30)), ("done", at(5), None)]
    path = str(tmp_path / "l")
    rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rocks.createDataFrame([("tick", at(1000), at(9000))], schema).coalesce(1).write.mode("append").parquet(path)
    rocks.createDataFrame([("tick", at(1100), at(9000))], schema).coalesce(1).write.mode("append").parquet(path)
    got = drain(St.expired_lease_stream(stream), tmp_path, "append", "leases")
    assert [r.run_id for r in got.collect()] == ["late"]


def test_handlers(spark):
    def work(context):
        context.info(f"start {context.task_id}")
        n = context.input()["n"]
        if n == 0:
            raise HandlerError("zero", retryable=False)
        if n == 1:
            raise RuntimeError("one")
        return {"n": n * 2, "signal": context.receive("go"), "none": context.receive("other")}

    rows = [("r0", "t0", '{"n": 0}', None), ("r1", "t1", '{"n": 1}', []), ("r2", "t2", '{"n": 21}', [("other2", "x"), ("go", "y")]), ("r3", "t3", "{bad", None)]
    todo = spark.createDataFrame(rows, "run_id string, task_id string, input string, signals array<struct<signal_name:string,payload:string>>")
    results = run_handlers(todo, work)
    got = {r.run_id: r for r in results.collect()}
    assert (got["r0"].success, got["r0"].retryable, got["r0"].error_message) == (False, False, "zero")
    assert (got["r1"].success, got["r1"].retryable) == (False, True) and got["r3"].retryable
    assert json.loads(got["r2"].output) == {"n": 42, "signal": "y", "none": None}
    assert [(r.task_run_id, r.level, r.message) for r in handler_logs(results).collect()][0] == ("r0", 2, "start t0")


def test_snapshot_events(spark):
    before = tasks(spark, *[{"id": k, "status": "RUNNING"} for k in ("done", "dead", "again", "same")], {"id": "back", "status": "RETRY"})
    after = tasks(spark, {"id": "done", "status": "COMPLETED"}, {"id": "dead", "status": "DEAD_LETTER"}, {"id": "again", "status": "RETRY"}, {"id": "same", "status": "RUNNING"}, {"id": "back", "status": "PENDING"}, {"id": "new"})
    got = {r.task_id: (r.new_status, r.queue_name, r.previous_status) for r in E.snapshot_events(before, after, AS_OF).collect()}
    assert got == {"done": (4, "", 0), "again": (6, "", 0), "new": (1, "default", 0)}
    assert {r.queue_name for r in E.snapshot_events(before, after, AS_OF, named=True).collect()} == {"default"}


def test_sse_round_trip_and_json(spark):
    e = spark.createDataFrame([("1", "t", "q", 4, 5)], "event_id string, task_id string, queue_name string, new_status int, timestamp_ms long")
    lines = E.sse_payload(e).select(F.concat(F.lit("data: "), "data").alias("value")).union(spark.createDataFrame([("",), ("event: x",), ("data: {bad",)], "value string"))
    assert [tuple(r) for r in E.parse_sse(lines).collect()] == [("1", "t", "q", 4, 5)]
    shown = json.loads(E.task_json(tasks(spark, {"id": "a"})).first().json)
    assert shown["scheduled_at"] is None and shown["created_at"] == "2024-05-01T12:00:00.000000Z" and "partition_id" not in shown
    wire = E.task_wire(tasks(spark, {"id": "a"})).first()
    assert (wire.status, wire.output, wire.idempotency_key) == (1, "", "")
