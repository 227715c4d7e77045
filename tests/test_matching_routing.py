import random

import pytest
from pyspark.sql import functions as F

from tasklathe.operators import cluster as C
from tasklathe.operators import matching as M
from tasklathe.operators import metrics as N
from tasklathe.operators import routing as G


def offers(spark, *rows):
    return spark.createDataFrame([(i, q, p, n) for n, (i, q, p) in enumerate(rows)], "id string, queue_name string, partition_id int, seq long")


def waiting(spark, *rows):
    return spark.createDataFrame([(s, s.split("-")[0], q, p, n) for n, (s, q, p) in enumerate(rows)], "slot string, worker_id string, queue_name string, partition_id int, seq long")


def pairs(frame):
    return sorted((r.id, r.slot) for r in frame.collect())


def test_first_come_first_matched_and_queues_apart(spark):
    t = offers(spark, ("a", "q", 0), ("b", "q", 0), ("c", "z", 0), ("d", "q", 1))
    s = waiting(spark, ("w1", "q", 0), ("w2", "z", 0))
    assert pairs(M.match_fifo(t, s)) == [("a", "w1"), ("c", "w2")]
    assert pairs(M.match_fifo(t, s.limit(0))) == [] and pairs(M.match_fifo(t.limit(0), s)) == []


def test_task_climbs_to_the_root(spark):
    got = M.match_tree(offers(spark, ("a", "q", 1)), waiting(spark, ("w", "q", 0)), 4, 2).collect()
    assert [(r.id, r.slot, r.partition_id, r.hops) for r in got] == [("a", "w", 0, 1)]
    deep = M.match_tree(offers(spark, ("a", "q", 14)), waiting(spark, ("w", "q", 0)), 15, 2).collect()
    assert [(r.hops, r.partition_id) for r in deep] == [(3, 0)]
    middle = M.match_tree(offers(spark, ("a", "q", 14), ("b", "q", 6)), waiting(spark, ("w", "q", 6), ("v", "q", 0)), 15, 2)
    assert pairs(middle) == [("a", "v"), ("b", "w")]


def test_slot_is_used_once_up_the_tree(spark):
    got = M.match_tree(offers(spark, ("a", "q", 1), ("b", "q", 2), ("c", "q", 0)), waiting(spark, ("w", "q", 0), ("v", "q", 0)), 4, 3)
    assert pairs(got) == [("a", "v"), ("c", "w")]


def test_overflow_goes_back(spark):
    t = offers(spark, *[(f"t{i}", "q", 0) for i in range(4)])
    got = {r.id: r.outcome for r in M.buffered(t, M.match_fifo(t, waiting(spark, ("w", "q", 0))), 2).collect()}
    assert got == {"t1": "BUFFERED", "t2": "BUFFERED", "t3": "RESET_PENDING"}


def test_dead_workers_are_passed_over(spark):
    s = waiting(spark, ("dead", "q", 0), ("w", "q", 0))
    ages = spark.createDataFrame([("dead", 31), ("w", 30)], "id string, heartbeat_age_s int")
    assert pairs(M.match_fifo(offers(spark, ("a", "q", 0)), M.without_dead(s, ages))) == [("a", "w")]
    gone = spark.createDataFrame([("w",)], "worker_id string")
    assert M.deregistered(s, gone).count() == 1


@pytest.mark.parametrize(("n", "b"), [(1, 3), (4, 3), (7, 2), (40, 3)])
def test_tree(spark, n, b):
    rows = {r.partition_id: r for r in M.partition_tree(spark, n, b).collect()}
    assert rows[0].parent_id is None and rows[0].depth == 0
    for p, r in rows.items():
        assert all(rows[c].parent_id == p and rows[c].depth == r.depth + 1 for c in r.children)
    assert max(r.depth for r in rows.values()) == M.tree_height(n, b)
    assert sum(len(r.children) for r in rows.values()) == n - 1


def test_workers_with_a_free_place_wait_on_every_partition(spark):
    w = spark.createDataFrame([("w", ["a", "b"], 5), ("x", ["a"], 0)], "worker_id string, queues array<string>, free int")
    got = sorted((r.queue_name, r.partition_id) for r in M.worker_slots(w, 4).collect())
    assert got == [(q, p) for q in "ab" for p in range(4)]


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def keys(spark, n=300):
    return spark.range(n).select(F.concat(F.lit("k-"), F.col("id").cast("string")).alias("queue_name"), F.lit(0).alias("partition_id"))


def owner_map(frame):
    return {r.queue_name: r.node for r in frame.collect()}


def test_ring_is_stable_and_moves_little(spark):
    two, again, three = (owner_map(G.owners(keys(spark), nodes(spark, *n))) for n in (("a", "b"), ("b", "a"), ("a", "b", "c")))
    assert two == again and set(two.values()) == {"a", "b"}
    moved = [k for k in two if two[k] != three[k]]
    assert 40 < len(moved) < 160 and all(three[k] == "c" for k in moved)
    assert set(owner_map(G.owners(keys(spark, 3), nodes(spark), own="me")).values()) == {"me"}


def test_membership_and_readers(spark):
    got = {(r.node, r.change) for r in G.membership_changes(nodes(spark, "a", "b"), nodes(spark, "b", "c")).collect()}
    assert got == {("c", "joined"), ("a", "left")}
    schema = "queue_name string, partition_id int"
    owned, reading = spark.createDataFrame([("q", 0), ("q", 1)], schema), spark.createDataFrame([("q", 1), ("q", 2)], schema)
    assert {tuple(r) for r in G.reconcile_readers(owned, reading).collect()} == {("q", 0, "start"), ("q", 2, "stop")}
    one = nodes(spark, "a")
    assert G.wanted_readers(owned, 4, one, "a").count() == 4 and G.wanted_readers(owned, 4, one, "b").count() == 0
    assert G.moved(G.owners(owned, one), G.owners(owned, nodes(spark, "z"))).count() == 2


def test_counters(spark):
    e = spark.createDataFrame([(1, "q"), (1, "q"), (4, "q"), (3, "q"), (6, "z")], "new_status int, queue_name string")
    sent = {(r.metric, r.queue_name): r.value for r in N.event_counters(e).collect()}
    assert sent == {("tasks_created_total", "q"): 2, ("tasks_completed_total", ""): 1, ("tasks_retried_total", ""): 1}
    assert {(r.metric, r.queue_name) for r in N.event_counters(e, as_sent=False).collect()} >= {("tasks_completed_total", "q")}


def test_one_place_waits_on_every_partition(spark):
    """A worker with one free place takes a task of its last queue's last partition, and only one."""
    workers = spark.createDataFrame([("w", ["a", "b"], 1), ("busy", ["a", "b"], 0)], "worker_id string, queues array<string>, free int")
    tasks = spark.createDataFrame([("t1", "b", 3, 1), ("t2", "b", 3, 2), ("t3", "b", 2, 3)], "id string, queue_name string, partition_id int, seq long")
    assert M.worker_slots(workers, 4).count() == 8
    assert [(r.id, r.worker_id, r["round"]) for r in M.match_workers(tasks, workers, 4, rounds=2).collect()] == [("t1", "w", 1)]
    two = workers.withColumn("free", F.lit(2))
    assert sorted((r.id, r["round"]) for r in M.match_workers(tasks, two.where("worker_id = 'w'"), 4, rounds=2).collect()) == [("t1", 1), ("t2", 2)]


def test_circuit_breaker():
    circuit = C.Circuit()
    assert circuit.call(0, False, False) == (2, "failed") and circuit.state == "closed"
    assert circuit.call(1000, False, True) == (1, "failed") and circuit.state == "open" and circuit.opened == 1
    assert circuit.call(5000, True, True) == (0, "refused")
    assert circuit.call(11_000, False, True) == (1, "failed") and circuit.opened == 2
    assert circuit.call(21_000, True, True) == (1, "ok") and circuit.state == "closed" and circuit.failures == 0
    assert circuit.call(22_000, False, True) == (2, "ok")


CALL = "addr string, seq long, at_ms long, first_ok boolean, retry_ok boolean"


def folded(rows):
    """The outcome of every call, address by address, one call after another."""
    circuits, out = {}, []
    for addr, seq, at, first_ok, retry_ok in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, *((x is not None, x or 0) for x in r[2:]))):
        circuit = circuits.setdefault(addr, C.Circuit())
        out.append((addr, seq, *circuit.call(float("nan") if at is None else at, first_ok, retry_ok), circuit.state, circuit.opened))
    return sorted(out, key=repr)


def test_an_addresss_calls_are_spread_over_tasks(spark):
    n = F.col("id")
    calls = spark.range(300_000).select(F.lit("a").alias("addr"), n.alias("seq"), (n * 900).alias("at_ms"), (n % 5 < 2).alias("first_ok"), (n % 11 == 0).alias("retry_ok"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        got = C.forward_calls(calls).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.set(coalesce, before)
    assert got.task.nunique() > 1
    want = folded([("a", i, i * 900, i % 5 < 2, i % 11 == 0) for i in range(300_000)])
    assert sorted(got.drop(columns="task").itertuples(index=False, name=None), key=repr) == want


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_blocks_of_calls_give_what_one_by_one_gives(spark, monkeypatch, bits):
    """Any circuit before a block; times that go back, repeat or are missing; numbers far apart, negative, repeated or missing."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    draw, rows = random.Random(bits), []
    for addr, ok, step in [("a", 0.3, (0, 4000)), ("b", 0.0, (0, 1)), ("c", 0.2, (-9000, 10_000)), ("d", 0.5, (9_999, 10_201)), (None, 0.1, (0, 900))]:
        seq, at = -20, 0
        for _ in range(150):
            seq, at = seq + draw.choice([0, 1, 1, 1, 1, 1 << 40]), at + draw.randint(*step)
            rows.append((addr, None if draw.random() < 0.02 else seq, None if addr == "c" and draw.random() < 0.02 else at, draw.random() < ok, draw.choice([True, False, False, None])))
    got = C.forward_calls(spark.createDataFrame(rows, CALL)).collect()
    assert sorted(map(tuple, got), key=repr) == folded(rows)
    assert any(r.outcome == "refused" for r in got) and any(r.circuit == "closed" for r in got)
    assert C.forward_calls(spark.createDataFrame([], CALL)).collect() == []


@pytest.mark.parametrize("kind", ["smallint", "int", "double"])
def test_times_of_any_number_type(spark, kind):
    """A retry after the type's last number; a break that ends on a fraction."""
    most = {"smallint": 2**15 - 1, "int": 2**31 - 1, "double": 10_400.5}[kind]
    rows = [("a", 0, 0, False, False), ("a", 70_000, most, False, False), ("a", 140_000, most, True, True)]
    rows = [(a, seq, float(at) if kind == "double" else at, *tries) for a, seq, at, *tries in rows]
    got = C.forward_calls(spark.createDataFrame(rows, CALL.replace("at_ms long", f"at_ms {kind}"))).collect()
    assert sorted(map(tuple, got), key=repr) == folded(rows)
