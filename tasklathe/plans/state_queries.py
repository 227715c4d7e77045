"""Transitions, sweeps, matching, routing, metrics and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import matching as M
from ..operators import metrics as N
from ..operators import routing as G
from ..operators import sweeps as S
from ..operators import transitions as T
from ..sources.fixtures import AS_OF
from .registry import query

DUE = "status = 'PENDING' AND (scheduled_at IS NULL OR scheduled_at <= $AS_OF)"
TURN = "row_number() OVER (PARTITION BY queue_name, partition_id ORDER BY priority DESC, created_at, id)"
LATEST = "(SELECT task_id, error_message FROM runs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt_number DESC) = 1)"
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def DEAD_ID(key: str) -> str:
    return f"substr(sha256('dead/' || t.id || '/' || {key}), 1, 32)"


def states(frame, *more: str):
    return frame.select("id", "status", *more)


@query("tasks", sql=f"SELECT id, queue_name, partition_id, priority, created_at FROM tasks WHERE {DUE} AND queue_name = '3-MEDIUM' AND partition_id = 2 ORDER BY priority DESC, created_at, id LIMIT 50")
def dequeue_topk_partition(v):
    return T.dequeue_choice(v.tasks, AS_OF, 50, "3-MEDIUM", 2).select("id", "queue_name", "partition_id", "priority", "created_at")


@query("tasks", sql=f"SELECT id, queue_name, partition_id FROM (SELECT *, {TURN} AS n FROM tasks WHERE {DUE}) WHERE n <= 20")
def dequeue_topk_all(v):
    return T.dequeue_choice(v.tasks, AS_OF, 20).select("id", "queue_name", "partition_id")


@query("tasks", sql=f"SELECT id, CASE WHEN id IN (SELECT id FROM (SELECT *, {TURN} AS n FROM tasks WHERE {DUE}) WHERE n <= 20) THEN 'DISPATCHING' ELSE status END AS status FROM tasks")
def dequeue_states(v):
    return states(T.dequeue(v.tasks, AS_OF, 20)[0])


@query("tasks", "runs", sql="SELECT id, CASE WHEN status = 'DISPATCHING' AND id NOT IN (SELECT task_id FROM runs WHERE status = 'RUNNING') THEN 'PENDING' ELSE status END AS status FROM tasks")
def recover_orphans(v):
    return states(T.recover_orphans(v.tasks, v.runs, AS_OF)[0])


def _doomed(v):
    return v.tasks.where("queue_name = '5-LOW'").select(F.col("id").alias("task_id"))


def _deleted(v):
    from ..schemas import Snapshot

    logs = v.logs.withColumn("task_run_id", F.concat("task_run_id", F.lit("-1")))
    none = v.signals.limit(0)
    return T.delete_task(Snapshot(v.tasks, v.runs, logs, none, v.workers, v.signals), _doomed(v))


@query("tasks", "runs", "logs", sql="SELECT id, task_run_id || '-1' AS task_run_id FROM logs WHERE task_run_id || '-1' NOT IN (SELECT r.id FROM runs r JOIN tasks t ON r.task_id = t.id WHERE t.queue_name = '5-LOW')")
def delete_cascade_logs(v):
    return _deleted(v)[0].logs.select("id", "task_run_id")


@query("tasks", "runs", sql="SELECT r.id FROM runs r WHERE task_id NOT IN (SELECT id FROM tasks WHERE queue_name = '5-LOW')")
def delete_cascade_runs(v):
    return _deleted(v)[0].runs.select("id")


@query("tasks", "signals", sql="SELECT s.id FROM signals s WHERE task_id NOT IN (SELECT id FROM tasks WHERE queue_name = '5-LOW')")
def delete_cascade_signals(v):
    return _deleted(v)[0].signals.select("id")


@query("tasks", sql="SELECT id FROM tasks WHERE queue_name = '5-LOW'")
def delete_existed(v):
    return _deleted(v)[1].select("id")


EXPIRED = "runs WHERE status = 'RUNNING' AND lease_expires_at < $AS_OF"
AFTER_REAP = "after_reap AS (SELECT * REPLACE (CASE WHEN status = 'RUNNING' AND lease_expires_at < $AS_OF THEN 'Lease expired' ELSE error_message END AS error_message, CASE WHEN status = 'RUNNING' AND lease_expires_at < $AS_OF THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' AND lease_expires_at < $AS_OF THEN $AS_OF ELSE completed_at END AS completed_at) FROM runs)"


@query("tasks", "runs", sql=f"SELECT id, CASE WHEN id NOT IN (SELECT task_id FROM {EXPIRED}) THEN status WHEN attempt_count < max_retries THEN 'RETRY' ELSE 'DEAD_LETTER' END AS status FROM tasks")
def reap_tasks(v):
    return states(S.reap(v.tasks, v.runs, AS_OF)[0])


@query("tasks", "runs", sql=f", {AFTER_REAP} SELECT id, status, error_message, completed_at FROM after_reap")
def reap_runs(v):
    return states(S.reap(v.tasks, v.runs, AS_OF)[1], "error_message", "completed_at")


@query("tasks", "runs", sql=f""", {AFTER_REAP} SELECT {DEAD_ID("x.id")} AS id, t.id AS task_id, t.queue_name, t.attempt_count, e.error_message
  FROM (SELECT id, task_id FROM {EXPIRED}) x JOIN tasks t ON x.task_id = t.id LEFT JOIN {LATEST.replace("runs", "after_reap")} e ON e.task_id = t.id WHERE t.attempt_count >= t.max_retries""")
def reap_dead_letters(v):
    return S.reap(v.tasks, v.runs, AS_OF)[2].select("id", "task_id", "queue_name", "attempt_count", "error_message")


@query("tasks", sql="SELECT id, CASE WHEN status = 'RETRY' AND scheduled_at IS NULL THEN $AS_OF + INTERVAL '1' SECOND * least(power(2, attempt_count), 3600)::BIGINT ELSE scheduled_at END AS scheduled_at FROM tasks")
def retry_schedule(v):
    return S.schedule_retries(v.tasks, AS_OF)[0].select("id", "scheduled_at")


@query("tasks", "runs", sql=f"SELECT {DEAD_ID('t.id')} AS id, t.id AS task_id, t.queue_name, t.task_name, t.attempt_count, e.error_message, $AS_OF AS created_at FROM tasks t LEFT JOIN {LATEST} e ON e.task_id = t.id WHERE t.status = 'FAILED' AND t.attempt_count >= t.max_retries")
def dlq_rows(v):
    return S.bury_exhausted(v.tasks, v.runs, AS_OF)[1].select("id", "task_id", "queue_name", "task_name", "attempt_count", "error_message", "created_at")


@query("tasks", "runs", sql=f"SELECT {DEAD_ID('t.id')} AS id, t.id AS task_id FROM tasks t WHERE t.status = 'FAILED' AND t.attempt_count >= t.max_retries AND queue_name = '1-URGENT' ORDER BY 1 DESC LIMIT 50")
def list_dead_letters(v):
    from ..operators.reads import list_dead_letters as listed

    return listed(S.bury_exhausted(v.tasks, v.runs, AS_OF)[1], "1-URGENT").select("id", "task_id")


@query("tasks", sql="SELECT id, CASE WHEN status = 'RETRY' AND scheduled_at <= $AS_OF THEN 'PENDING' ELSE status END AS status, CASE WHEN status = 'RETRY' AND scheduled_at <= $AS_OF THEN NULL ELSE scheduled_at END AS scheduled_at FROM tasks")
def promote_delayed(v):
    return states(T.promote_delayed(v.tasks, AS_OF)[0], "scheduled_at")


@query("tasks", sql="SELECT id, CASE WHEN id = '2' AND status IN ('PENDING', 'RETRY', 'RUNNING', 'DISPATCHING') THEN 'CANCELLED' ELSE status END AS status FROM tasks")
def cancel_any(v):
    return states(T.cancel(v.tasks, "2", AS_OF)[0])


@query("tasks", sql="SELECT id, CASE WHEN id = '2' AND status IN ('PENDING', 'RETRY') THEN 'CANCELLED' ELSE status END AS status FROM tasks")
def cancel_parked(v):
    return states(T.cancel(v.tasks, "2", AS_OF, running_too=False)[0])


@query("tasks", sql="SELECT id, CASE WHEN id = '3' THEN 'RUNNING' ELSE status END AS status, CASE WHEN id = '3' THEN attempt_count + 1 ELSE attempt_count END AS attempt_count FROM tasks")
def status_and_attempt(v):
    return states(T.increment_attempt(T.set_status(v.tasks, "3", "RUNNING", AS_OF)[0], "3", AS_OF)[0], "attempt_count")


def _results(v):
    """A made-up result for the latest run of every task whose number isn't divisible by 3."""
    from ..operators.reads import latest_runs

    n = F.col("task_id").cast("long")
    return latest_runs(v.runs).where(n % 3 != 0).select(
        F.col("id").alias("run_id"), "task_id", (n % 3 == 1).alias("success"), (n % 2 == 0).alias("retryable"), F.when(n % 5 == 0, "not json").otherwise('{"n": 1}').alias("output"), F.lit("boom").alias("error_message")
    )


RESULTS = "res AS (SELECT id AS run_id, task_id, task_id::BIGINT % 3 = 1 AS success, task_id::BIGINT % 2 = 0 AS retryable FROM runs WHERE task_id::BIGINT % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt_number DESC) = 1)"


@query("tasks", "runs", sql=f", {RESULTS} SELECT t.id, CASE WHEN r.task_id IS NULL THEN t.status WHEN success THEN 'COMPLETED' WHEN retryable THEN 'RETRY' ELSE 'FAILED' END AS status FROM tasks t LEFT JOIN res r ON r.task_id = t.id")
def apply_results_tasks(v):
    return states(T.apply_results(v.tasks, v.runs, _results(v), AS_OF)[0])


@query("tasks", "runs", sql=f", {RESULTS} SELECT n.id, CASE WHEN r.run_id IS NULL OR n.status <> 'RUNNING' THEN n.status WHEN success THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN r.run_id IS NULL OR n.status <> 'RUNNING' OR success THEN n.error_message ELSE 'boom' END AS error_message FROM runs n LEFT JOIN res r ON r.run_id = n.id")
def apply_results_runs(v):
    return states(T.apply_results(v.tasks, v.runs, _results(v), AS_OF)[1], "error_message")


def _assignments(v):
    return v.tasks.where("status = 'DISPATCHING'").select(F.col("id").alias("task_id"), F.concat(F.lit("w"), F.col("priority").cast("string")).alias("worker_id"), F.lit("node-1").alias("node_id"))


@query("tasks", sql="SELECT substr(sha256(id || '/' || (attempt_count + 1)), 1, 32) AS id, id AS task_id, attempt_count + 1 AS attempt_number, 'w' || priority AS worker_id, $AS_OF + INTERVAL '1' SECOND * (timeout_seconds + 30) AS lease_expires_at FROM tasks WHERE status = 'DISPATCHING'")
def dispatch_runs(v):
    return T.dispatch(v.tasks, _assignments(v), AS_OF)[1].select("id", "task_id", "attempt_number", "worker_id", "lease_expires_at")


@query("tasks", "runs", sql="SELECT id, CASE WHEN status = 'DISPATCHING' THEN 'RUNNING' ELSE status END AS status, CASE WHEN status = 'DISPATCHING' THEN attempt_count + 1 ELSE attempt_count END AS attempt_count FROM tasks")
def dispatch_tasks(v):
    return states(T.checked_dispatch(v.tasks, v.runs, _assignments(v), AS_OF)[0], "attempt_count")


@query("tasks", "runs", sql="SELECT id, CASE WHEN status = 'RUNNING' AND task_id IN (SELECT id FROM tasks WHERE status = 'RUNNING') THEN $AS_OF + INTERVAL '60' SECOND ELSE lease_expires_at END AS lease_expires_at FROM runs")
def heartbeat_extend(v):
    return T.heartbeat(v.runs, v.tasks.where("status = 'RUNNING'").select(F.col("id").alias("task_id")), AS_OF)[0].select("id", "lease_expires_at")


def _some_signals(v):
    return v.signals.where(F.col("id").cast("long") % 2 == 0).select("id")


@query("signals", sql="SELECT id, CASE WHEN status = 'PENDING' AND id::BIGINT % 2 = 0 THEN 'DELIVERED' ELSE status END AS status, CASE WHEN status = 'PENDING' AND id::BIGINT % 2 = 0 THEN $AS_OF ELSE delivered_at END AS delivered_at FROM signals")
def signal_deliver(v):
    return states(T.deliver_signals(v.signals, _some_signals(v), AS_OF)[0], "delivered_at")


@query("signals", sql="SELECT id, CASE WHEN status = 'DELIVERED' AND id::BIGINT % 2 = 0 THEN 'ACKNOWLEDGED' ELSE status END AS status, CASE WHEN status = 'DELIVERED' AND id::BIGINT % 2 = 0 THEN $AS_OF ELSE acknowledged_at END AS acknowledged_at FROM signals")
def signal_ack(v):
    return states(T.acknowledge_signals(v.signals, _some_signals(v), AS_OF)[0], "acknowledged_at")


@query("signals", sql="SELECT id, CASE WHEN status = 'DELIVERED' AND task_id::BIGINT % 2 = 0 THEN 'PENDING' ELSE status END AS status, CASE WHEN status = 'DELIVERED' AND task_id::BIGINT % 2 = 0 THEN NULL ELSE delivered_at END AS delivered_at FROM signals")
def signal_reset(v):
    return states(T.reset_signals(v.signals, v.signals.where(F.col("task_id").cast("long") % 2 == 0))[0], "delivered_at")


@query("tasks", "runs", sql=f"""SELECT (SELECT count(*) FROM {EXPIRED}) AS reaped, count(*) FILTER (WHERE status = 'RETRY' AND scheduled_at IS NULL) AS retried,
  count(*) FILTER (WHERE status = 'FAILED' AND attempt_count >= max_retries) AS dead_lettered, count(*) FILTER (WHERE status = 'RETRY' AND scheduled_at <= $AS_OF) AS promoted FROM tasks""")
def sweep_counts(v):
    return S.sweep_counts(v.tasks, v.runs, AS_OF)


@query("tasks", "runs", sql=f"""SELECT id, CASE WHEN s3 = 'RETRY' AND scheduled_at <= $AS_OF THEN 'PENDING' ELSE s3 END AS status FROM (
  SELECT *, CASE WHEN s2 = 'FAILED' AND attempt_count >= max_retries THEN 'DEAD_LETTER' ELSE s2 END AS s3 FROM (
    SELECT *, CASE WHEN id NOT IN (SELECT task_id FROM {EXPIRED}) THEN status WHEN attempt_count < max_retries THEN 'RETRY' ELSE 'DEAD_LETTER' END AS s2 FROM tasks))""")
def sweep_states(v):
    from ..schemas import Snapshot

    dead = S.bury_exhausted(v.tasks, v.runs, AS_OF)[1].limit(0)
    return states(S.sweep(Snapshot(v.tasks, v.runs, v.logs, dead, v.workers, v.signals), AS_OF).tasks)


def _offers(v):
    return v.tasks.where("status = 'PENDING'").select("id", "queue_name", "partition_id", F.col("id").cast("long").alias("seq"))


def _slots(v):
    """Waiting slots made up from suppliers: a queue and partition each."""
    n = F.col("id").cast("long")
    queue = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))), (n % 5 + 1).cast("int"))
    base = v.workers.select(n.alias("n"), queue.alias("queue_name"), (F.floor(n / 5) % 4).cast("int").alias("partition_id"), "concurrency", F.col("id").alias("worker_id"))
    spread = base.select("*", F.explode(F.sequence(F.lit(0), F.col("concurrency") - 1)).alias("j"))
    return spread.select(F.concat_ws("#", "worker_id", F.col("j").cast("string")).alias("slot"), "worker_id", "queue_name", "partition_id", (F.col("n") * 10 + F.col("j")).alias("seq"))


OFFERS = "offers AS (SELECT id, queue_name, partition_id, id::BIGINT AS seq FROM tasks WHERE status = 'PENDING')"
SLOTS = "slots AS (SELECT id || '#' || j AS slot, id AS worker_id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][id::BIGINT % 5 + 1] AS queue_name, (id::BIGINT // 5 % 4)::INTEGER AS partition_id, id::BIGINT * 10 + j AS seq FROM (SELECT *, unnest(range(concurrency)) AS j FROM workers))"
RANK = "row_number() OVER (PARTITION BY queue_name, partition_id ORDER BY seq, {})"
DIRECT = f"ot AS (SELECT *, {RANK.format('id')} AS k FROM offers), os AS (SELECT *, {RANK.format('slot')} AS k FROM slots), hit0 AS (SELECT ot.id, os.slot, ot.queue_name, ot.partition_id FROM ot JOIN os USING (queue_name, partition_id, k))"
CLIMB = f"""up AS (SELECT o.id, o.queue_name, 0 AS partition_id, o.seq FROM offers o WHERE o.partition_id > 0 AND o.id NOT IN (SELECT id FROM hit0)),
 ut AS (SELECT *, {RANK.format("id")} AS k FROM up), us AS (SELECT *, {RANK.format("slot")} AS k FROM slots WHERE slot NOT IN (SELECT slot FROM hit0)),
 hit1 AS (SELECT ut.id, us.slot, ut.queue_name, ut.partition_id FROM ut JOIN us USING (queue_name, partition_id, k))"""


@query("tasks", "workers", sql=f", {OFFERS}, {SLOTS}, {DIRECT} SELECT * FROM hit0")
def match_fifo(v):
    return M.match_fifo(_offers(v), _slots(v))


@query("tasks", "workers", sql=f", {OFFERS}, {SLOTS}, {DIRECT}, {CLIMB} SELECT *, 0 AS hops FROM hit0 UNION ALL SELECT *, 1 AS hops FROM hit1")
def match_tree(v):
    return M.match_tree(_offers(v), _slots(v), partitions=4, branching=3)


@query("tasks", "workers", sql=f", {OFFERS}, {SLOTS}, {DIRECT} SELECT id, queue_name, partition_id, CASE WHEN {RANK.format('id')} <= 10 THEN 'BUFFERED' ELSE 'RESET_PENDING' END AS outcome FROM offers WHERE id NOT IN (SELECT id FROM hit0)")
def match_overflow(v):
    offers = _offers(v)
    return M.buffered(offers, M.match_fifo(offers, _slots(v)), 10)


@query("tasks", "workers", sql=f", {OFFERS}, {SLOTS}, {DIRECT} SELECT count(*) AS sync, count(*) FILTER (WHERE id::BIGINT % 16 = 0) AS async FROM hit0")
def match_totals(v):
    offers = _offers(v)
    return M.match_totals(M.match_fifo(offers, _slots(v)), offers.where("seq % 16 = 0"))


@query("tasks", "workers", sql=f", {OFFERS}, {SLOTS} SELECT slot, worker_id, queue_name, partition_id FROM slots WHERE worker_id NOT IN (SELECT id FROM workers WHERE heartbeat_age_s > 30)")
def live_slots(v):
    return M.without_dead(_slots(v), v.workers).select("slot", "worker_id", "queue_name", "partition_id")


@query(sql="SELECT p::INTEGER AS partition_id, CASE WHEN p > 0 THEN ((p - 1) // 3)::INTEGER END AS parent_id, CASE WHEN p = 0 THEN 0 WHEN p <= 3 THEN 1 WHEN p <= 12 THEN 2 ELSE 3 END AS depth, len(list_filter([p * 3 + 1, p * 3 + 2, p * 3 + 3], lambda c: c < 40))::INTEGER AS children FROM range(40) t(p)")
def partition_tree(v):
    return M.partition_tree(v.spark, 40, 3).withColumn("children", F.size("children"))


@query("workers", sql="SELECT w.id AS worker_id, 'q' || (s // 4) AS queue_name, (s % 4)::INTEGER AS partition_id, s::INTEGER AS slot_seq FROM workers w, range(8) t(s) WHERE w.concurrency > 0")
def worker_slots(v):
    return M.worker_slots(v.workers.select(F.col("id").alias("worker_id"), F.array(F.lit("q0"), F.lit("q1")).alias("queues"), F.col("concurrency").alias("free")), 4)


VNODES = f"vn AS (SELECT node, {HASH.format("node || '#vn' || i")} AS h FROM (SELECT DISTINCT node_id AS node FROM workers), range(64) t(i))"
OWNED = f"""k AS (SELECT DISTINCT queue_name, partition_id, {HASH.format("queue_name || ':' || partition_id")} AS h FROM tasks),
 owner AS (SELECT k.queue_name, k.partition_id, vn.node FROM k, vn QUALIFY row_number() OVER (PARTITION BY k.queue_name, k.partition_id ORDER BY CASE WHEN vn.h >= k.h THEN 0 ELSE 1 END, vn.h, vn.node) = 1)"""


def _nodes(v):
    return v.workers.select(F.col("node_id").alias("node")).distinct()


@query("tasks", "workers", sql=f", {VNODES}, {OWNED} SELECT * FROM owner")
def ring_owner(v):
    return G.owners(v.tasks, _nodes(v))


@query("workers", sql="SELECT node_id AS node, 'left' AS change FROM workers GROUP BY node_id HAVING node_id = 'node-2' UNION ALL SELECT 'node-9', 'joined'")
def membership_diff(v):
    after = _nodes(v).where("node <> 'node-2'").unionByName(v.spark.range(1).select(F.lit("node-9").alias("node")))
    return G.membership_changes(_nodes(v), after)


@query("tasks", "workers", sql=f", {VNODES}, {OWNED} SELECT queue_name, partition_id, 'start' AS action FROM owner WHERE node = 'node-1' AND partition_id <> 0 UNION ALL SELECT DISTINCT queue_name, partition_id, 'stop' FROM tasks t WHERE partition_id = 0 AND (queue_name, partition_id) NOT IN (SELECT (queue_name, partition_id) FROM owner WHERE node = 'node-1')")
def reader_reconcile(v):
    owned = G.wanted_readers(v.tasks, 4, _nodes(v), "node-1")
    return G.reconcile_readers(owned, v.tasks.where("partition_id = 0").select("queue_name", "partition_id").distinct())


@query("task_events", sql="""SELECT metric, queue_name, count(*) AS value FROM (
  SELECT CASE new_status WHEN 1 THEN 'tasks_created_total' WHEN 4 THEN 'tasks_completed_total' WHEN 5 THEN 'tasks_failed_total' WHEN 6 THEN 'tasks_retried_total' END AS metric,
    CASE WHEN new_status = 1 THEN queue_name ELSE '' END AS queue_name FROM task_events) WHERE metric IS NOT NULL GROUP BY ALL""")
def metrics_counters(v):
    return N.event_counters(v.task_events)


@query("tasks", "runs", sql="SELECT queue_name, count(*) AS value FROM tasks WHERE status = 'FAILED' AND attempt_count >= max_retries GROUP BY queue_name")
def metrics_dead_lettered(v):
    return N.dead_lettered(S.bury_exhausted(v.tasks, v.runs, AS_OF)[1])


@query("workers", sql="SELECT count(*) AS value FROM workers WHERE heartbeat_age_s <= 30")
def metrics_active_workers(v):
    return N.active_workers(v.workers)


PCT = ", ".join(f"round(quantile_cont({{0}}, {m}))::BIGINT AS p{round(m * 100)}" for m in (0.5, 0.9, 0.99))


@query("tasks", "runs", sql=f"SELECT queue_name, {PCT.format('w')}, count(*) AS n FROM (SELECT t.queue_name, (epoch_ms(r.started_at) - epoch_ms(t.created_at))::DOUBLE AS w FROM tasks t JOIN runs r ON r.task_id = t.id WHERE r.attempt_number = 1) GROUP BY queue_name")
def dispatch_latency_pct(v):
    return N.dispatch_latency(v.tasks, v.runs)


@query("runs", sql=f"SELECT status, {PCT.format('d')}, count(*) AS n FROM (SELECT status, (epoch_ms(completed_at) - epoch_ms(started_at))::DOUBLE AS d FROM runs WHERE completed_at IS NOT NULL) GROUP BY status")
def run_duration_pct(v):
    return N.run_duration(v.runs)


@query("tasks", "runs", sql=f"""SELECT id AS task_id, CASE WHEN status = 'FAILED' OR s2 = 'RETRY' THEN '' ELSE queue_name END AS queue_name, 6 AS new_status, epoch_ms($AS_OF)::BIGINT AS timestamp_ms FROM (
  SELECT *, CASE WHEN id NOT IN (SELECT task_id FROM {EXPIRED}) THEN status WHEN attempt_count < max_retries THEN 'RETRY' ELSE 'DEAD_LETTER' END AS s2 FROM tasks) WHERE s2 <> status AND s2 = 'RETRY'""")
def snapshot_events(v):
    after, _, _ = S.reap(v.tasks, v.runs, AS_OF)
    return E.snapshot_events(v.tasks, after, AS_OF).select("task_id", "queue_name", "new_status", "timestamp_ms")


@query("task_events", sql="SELECT * FROM task_events WHERE node_id IN ('', 'node-1')")
def relay_filter(v):
    return E.to_relay(v.task_events, "node-1")


@query("task_events", sql="SELECT event_id, task_id FROM task_events")
def relay_dedupe(v):
    return E.relayed(v.task_events, E.to_relay(v.task_events, "node-1")).select("event_id", "task_id")


@query("task_events", sql="""SELECT '{"event_id":"' || event_id || '","task_id":"' || task_id || '","queue_name":"' || queue_name || '","new_status":' || new_status || ',"timestamp_ms":' || (epoch_us(ts) // 1000) || '}' AS data FROM task_events""")
def sse_payload(v):
    from ..functions import to_millis

    return E.sse_payload(v.task_events.withColumn("timestamp_ms", to_millis(F.col("ts"))))


@query("tasks", sql="""SELECT id, '{"id":"' || id || '","queue_name":"' || queue_name || '","task_name":"' || task_name || '","status":"' || status || '","priority":' || priority || ',"max_retries":' || max_retries || ',"attempt_count":' || attempt_count || ',"timeout_seconds":' || timeout_seconds
  || ',"scheduled_at":' || coalesce('"' || strftime(scheduled_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"', 'null') || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}' AS json FROM tasks""")
def task_json(v):
    return E.task_json(v.tasks)


@query("signals", sql="SELECT task_id, signal_name, arg_min(id, (created_at, id)) AS id FROM signals WHERE status = 'PENDING' GROUP BY task_id, signal_name")
def first_signal_by_name(v):
    """Selective receive: the oldest pending signal of each name a task may wait for."""
    oldest = F.min_by("id", F.struct("created_at", "id"))
    return v.signals.where("status = 'PENDING'").groupBy("task_id", "signal_name").agg(oldest.alias("id"))


@query("signals", "tasks", sql="SELECT s.id, s.task_id FROM signals s JOIN tasks t ON s.task_id = t.id WHERE t.status = 'DISPATCHING' AND s.status = 'PENDING'")
def signals_on_dispatch(v):
    """Signals that go out with new assignments."""
    return v.signals.where("status = 'PENDING'").join(_assignments(v).select("task_id"), "task_id").select("id", "task_id")


@query("tasks", sql="SELECT id AS task_id, attempt_count::BIGINT * 2 AS doubled FROM tasks WHERE status = 'RUNNING' AND attempt_count > 0")
def handler_udf(v):
    """A user handler that doubles its input, and fails for good where there is nothing to double."""
    from ..functions import json_field
    from ..udf import HandlerError, run_handlers

    def double(context):
        n = context.input()["n"]
        if n == 0:
            raise HandlerError("nothing to double", retryable=False)
        return {"n": 2 * n}

    todo = v.tasks.where("status = 'RUNNING'").select(F.col("id").alias("task_id"), F.concat("id", F.lit("-run")).alias("run_id"), F.to_json(F.struct(F.col("attempt_count").alias("n"))).alias("input"))
    return run_handlers(todo, double).where("success").select("task_id", json_field(F.col("output"), "$.n", "bigint").alias("doubled"))
