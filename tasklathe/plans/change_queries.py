"""Inserts, single-row transitions, wire shapes, slots and cluster figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import cluster as C
from ..operators import events as E
from ..operators import inserts as I
from ..operators import matching as M
from ..operators import metrics as N
from ..operators import reads as R
from ..operators import sweeps as S
from ..operators import transitions as T
from ..schemas import Snapshot
from ..sources.fixtures import AS_OF
from .registry import query
from .state_queries import DIRECT, OFFERS, OWNED, SLOTS, VNODES, _nodes, _offers, _slots, states

LATER = "1998-06-16 00:00:00"


@query("runs", sql="SELECT * FROM runs WHERE id = '17-1'")
def get_run(v):
    return R.by_id(v.runs, "17-1")


def _workers(v):
    """Workers with the columns of live ones: connected a minute before their last heartbeat."""
    seen = X.scalar.plus_seconds(X.moment(AS_OF), -F.col("heartbeat_age_s"))
    return v.workers.withColumns({"last_heartbeat": seen, "connected_at": X.scalar.plus_seconds(seen, -60), "queues": F.array(F.lit("q0"), F.lit("q1")), "active_tasks": F.array(F.col("id"), F.col("id"), F.col("name"))})


@query("workers", sql="SELECT id, name, status, $AS_OF - INTERVAL '1' SECOND * (heartbeat_age_s + 60) AS connected_at FROM workers")
def list_workers(v):
    return R.list_workers(_workers(v)).select("id", "name", "status", "connected_at")


@query("workers", sql="SELECT id, name, node_id, concurrency, 2 AS active_tasks, 'CONNECTED' AS status, $AS_OF - INTERVAL '1' SECOND * heartbeat_age_s AS last_heartbeat FROM workers")
def connected_workers(v):
    return R.connected_workers(_workers(v)).select("id", "name", "node_id", "concurrency", "active_tasks", "status", "last_heartbeat")


N_ID = "id::BIGINT"


@query("tasks", sql=f"""SELECT 'n' || id AS id, queue_name, task_name, 'PENDING' AS status, CASE WHEN {N_ID} % 2 = 0 THEN priority ELSE 0 END AS priority, CASE WHEN {N_ID} % 3 = 1 THEN 7 ELSE 3 END AS max_retries,
  300 AS timeout_seconds, 0 AS attempt_count, '{{}}' AS metadata, $AS_OF AS created_at FROM tasks""")
def new_tasks(v):
    n = F.col("id").cast("long")
    asked = v.tasks.select(F.concat(F.lit("n"), "id").alias("id"), "queue_name", "task_name", F.when(n % 2 == 0, F.col("priority")).alias("priority"), F.when(n % 3 == 0, 0).when(n % 3 == 1, 7).alias("max_retries"))
    rows = I.new_tasks(asked, AS_OF, zero_is_unset=True)
    return rows.select("id", "queue_name", "task_name", "status", "priority", "max_retries", "timeout_seconds", "attempt_count", "metadata", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def _inserted(v):
    """Every third task holds a key; new ones ask for keys in pairs, some for none."""
    n = F.col("id").cast("long")
    held = v.tasks.select("id", F.when(n % 3 == 0, F.concat(F.lit("k"), "id")).alias("idempotency_key"))
    asked = v.tasks.select(F.concat(F.lit("n"), "id").alias("id"), F.when(n % 5 != 0, F.concat(F.lit("k"), (n - n % 2).cast("string"))).alias("idempotency_key"))
    return I.insert_tasks(held, asked)


ASKED = f"""held AS (SELECT id, CASE WHEN {N_ID} % 3 = 0 THEN 'k' || id END AS idempotency_key FROM tasks),
 asked AS (SELECT 'n' || id AS id, CASE WHEN {N_ID} % 5 <> 0 THEN 'k' || ({N_ID} - {N_ID} % 2) END AS idempotency_key FROM tasks),
 told AS (SELECT a.*, idempotency_key IS NOT NULL AND (idempotency_key IN (SELECT idempotency_key FROM held WHERE idempotency_key IS NOT NULL) OR id <> min(id) OVER (PARTITION BY idempotency_key)) AS refused FROM asked a)"""


@query("tasks", sql=f", {ASKED} SELECT * FROM held UNION ALL SELECT id, idempotency_key FROM told WHERE NOT refused")
def insert_accepted(v):
    return _inserted(v)[0].select("id", "idempotency_key")


@query("tasks", sql=f", {ASKED} SELECT id, idempotency_key FROM told WHERE refused")
def insert_refused(v):
    return _inserted(v)[1]


@query("logs", sql="SELECT 100 + row_number() OVER (ORDER BY task_run_id::BIGINT, timestamp_ms, id) - 1 AS id, task_run_id, timestamp_ms, CASE WHEN level = 'DEBUG' THEN 'INFO' ELSE level END AS level, message FROM logs")
def bulk_logs(v):
    """Logs of a run as one batch of columns, a level among them that nobody knows."""
    level = F.when(F.col("level") == "DEBUG", "TRACE").otherwise(F.col("level"))
    entries = v.logs.groupBy("task_run_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "id", level.alias("level"), "message"))).alias("e"))
    column = lambda c: F.transform("e", lambda x: x[c]).alias(c)
    batches = entries.select(F.col("task_run_id").cast("long").alias("batch_id"), F.transform("e", lambda x: F.col("task_run_id")).alias("task_run_id"), column("timestamp_ms"), column("level"), column("message"), F.transform("e", lambda x: F.lit("{}")).alias("metadata"))
    return I.log_rows(batches, AS_OF, 100).select("id", "task_run_id", "timestamp_ms", "level", "message")


@query("signals", sql="SELECT substr(sha256(concat_ws('/', task_id, signal_name, coalesce(payload, ''), id)), 1, 32) AS id, task_id, signal_name, 'PENDING' AS status FROM signals")
def new_signals(v):
    return I.new_signals(v.signals.select("task_id", "signal_name", "payload", F.col("id").alias("seq")), AS_OF).select("id", "task_id", "signal_name", "status")


@query("logs", sql="SELECT * FROM logs WHERE task_run_id = '3' ORDER BY timestamp_ms, id LIMIT 10000")
def log_history(v):
    return R.log_history(v.logs, "3", include_history=True)


@query("logs", sql="SELECT * FROM logs WHERE false")
def log_history_left_out(v):
    return R.log_history(v.logs, "3", include_history=False)


@query("logs", sql="SELECT id, timestamp_ms // 500 AS tick, ((row_number() OVER (PARTITION BY timestamp_ms // 500 ORDER BY timestamp_ms, id) - 1) // 100)::BIGINT AS part FROM logs")
def log_flushes(v):
    return I.flushes(v.logs).select("id", "tick", "part")


@query("logs", sql="SELECT id, task_run_id, CASE level WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 ELSE 0 END AS level FROM logs")
def log_wire(v):
    return E.log_wire(v.logs).select("id", "task_run_id", "level")


@query("tasks", sql="SELECT id, '' AS error_message, CASE status WHEN 'PENDING' THEN 1 WHEN 'DISPATCHING' THEN 2 WHEN 'RUNNING' THEN 3 WHEN 'COMPLETED' THEN 4 WHEN 'FAILED' THEN 5 WHEN 'RETRY' THEN 6 WHEN 'DEAD_LETTER' THEN 7 WHEN 'CANCELLED' THEN 8 ELSE 0 END AS status FROM tasks")
def task_wire(v):
    return E.task_wire(v.tasks.withColumn("error_message", F.lit(None).cast("string"))).select("id", "error_message", "status")


@query("runs", sql="""SELECT id, '{"id":"' || id || '","status":"' || status || '","error_message":' || coalesce('"' || error_message || '"', 'null') || ',"started_at":"' || strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","completed_at":' || coalesce('"' || strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"', 'null') || '}' AS json FROM runs""")
def run_json(v):
    return E.run_json(v.runs.select("id", "status", "error_message", "started_at", "completed_at"))


@query("logs", sql="""SELECT id, '{"id":' || id || ',"task_run_id":"' || task_run_id || '","timestamp_ms":' || timestamp_ms || ',"level":"' || level || '"}' AS json FROM logs""")
def log_json(v):
    return E.log_json(v.logs.select("id", "task_run_id", "timestamp_ms", "level"))


@query("task_events", sql="SELECT event_id, task_id, queue_name, new_status, (epoch_us(ts) // 1000)::BIGINT AS timestamp_ms FROM task_events")
def parse_sse(v):
    lines = E.sse_payload(v.task_events.withColumn("timestamp_ms", X.to_millis(F.col("ts")))).select(F.concat(F.lit("data: "), "data").alias("value"))
    return E.parse_sse(lines.unionByName(v.spark.range(1).select(F.lit(": keep alive").alias("value"))))


def _one(status: str, **more: str) -> str:
    return f"SELECT id, CASE WHEN id = '3' THEN '{status}' ELSE status END AS status FROM tasks"


@query("tasks", sql="SELECT id, CASE WHEN id = '3' THEN 'RETRY' ELSE status END AS status, CASE WHEN id = '3' THEN TIMESTAMP '1998-06-16 00:00:00' ELSE scheduled_at END AS scheduled_at FROM tasks")
def schedule_one_retry(v):
    return states(T.schedule_retry(v.tasks, "3", LATER, AS_OF)[0], "scheduled_at")


@query("tasks", sql=_one("DEAD_LETTER"))
def dead_letter_one(v):
    return states(T.move_to_dead_letter(v.tasks, "3", AS_OF)[0])


@query("tasks", sql="SELECT id, CASE WHEN id = '3' THEN 'COMPLETED' ELSE status END AS status, CASE WHEN id = '3' THEN '{\"n\":1}' END AS output, 'old' AS error_message FROM tasks")
def complete_one_task(v):
    none = F.lit(None).cast("string")
    return states(T.complete_task(v.tasks.withColumns({"output": none, "error_message": F.lit("old")}), "3", '{"n":1}', AS_OF)[0], "output", "error_message")


@query("tasks", sql="SELECT id, CASE WHEN id = '3' THEN 'FAILED' ELSE status END AS status, CASE WHEN id = '3' THEN 'boom' ELSE 'old' END AS error_message FROM tasks")
def fail_one_task(v):
    return states(T.fail_task(v.tasks.withColumn("error_message", F.lit("old")), "3", "boom", AS_OF)[0], "error_message")


RUNNING = "(SELECT min(id) FROM runs WHERE status = 'RUNNING')"


def _running(v) -> str:
    return v.runs.where("status = 'RUNNING'").agg(F.min("id")).first()[0] or ""


@query("runs", sql=f"SELECT id, CASE WHEN id = {RUNNING} THEN 'COMPLETED' ELSE status END AS status, CASE WHEN id = {RUNNING} THEN $AS_OF ELSE completed_at END AS completed_at FROM runs")
def complete_one_run(v):
    return states(T.complete_run(v.runs, _running(v), None, AS_OF)[0], "completed_at")


@query("runs", sql=f"SELECT id, CASE WHEN id = {RUNNING} THEN 'FAILED' ELSE status END AS status, CASE WHEN id = {RUNNING} THEN 'boom' ELSE error_message END AS error_message FROM runs")
def fail_one_run(v):
    return states(T.fail_run(v.runs, _running(v), "boom", AS_OF)[0], "error_message")


@query("runs", sql="SELECT id, status, completed_at FROM runs")
def complete_ended_run(v):
    """A run that isn't running stays as it is."""
    ended = v.runs.where("status = 'FAILED'").agg(F.min("id")).first()[0] or ""
    return states(T.complete_run(v.runs, ended, None, AS_OF)[0], "completed_at")


@query("runs", sql=f"SELECT id, CASE WHEN id = {RUNNING} THEN TIMESTAMP '1998-06-16 00:00:00' ELSE lease_expires_at END AS lease_expires_at FROM runs")
def heartbeat_one_run(v):
    return T.heartbeat_run(v.runs, _running(v), LATER, AS_OF)[0].select("id", "lease_expires_at")


@query("tasks", sql="SELECT id, CASE WHEN status = 'DISPATCHING' AND id::BIGINT % 2 = 1 THEN 'PENDING' ELSE status END AS status FROM tasks")
def reset_dispatching(v):
    return states(T.reset_dispatching(v.tasks, v.tasks.where(F.col("id").cast("long") % 2 == 1).select("id"), AS_OF)[0])


@query("tasks", sql="SELECT count(*) AS deleted FROM tasks")
def clear_all(v):
    none = v.signals.limit(0)
    return T.clear_all(Snapshot(v.tasks, v.runs, v.logs, none, v.workers, v.signals))[1]


@query("tasks", sql="""SELECT id, $AS_OF + INTERVAL '1' SECOND * least(power(2, attempt_count), 3600)::BIGINT AS scheduled_at FROM tasks
  WHERE status = 'RETRY' AND scheduled_at IS NULL ORDER BY id LIMIT 100""")
def retry_batch_of_100(v):
    return S.schedule_retries(v.tasks, AS_OF, limit=100)[1].select("id", "scheduled_at")


@query("tasks", sql="SELECT id AS task_id, queue_name, attempt_count FROM tasks WHERE status = 'FAILED' AND attempt_count >= max_retries ORDER BY id LIMIT 100")
def dlq_batch_of_100(v):
    return S.bury_exhausted(v.tasks, v.runs, AS_OF, limit=100)[1].select("task_id", "queue_name", "attempt_count")


@query("signals", sql="SELECT id, created_at AS parsed, date_trunc('millisecond', created_at) AS from_millis FROM signals")
def parsed_times(v):
    plain = lambda c: c.cast("timestamp_ntz")
    at = F.col("created_at").cast("timestamp")
    return v.signals.select("id", plain(X.parse_rfc3339(X.rfc3339(at))).alias("parsed"), plain(X.from_millis(X.to_millis(F.col("created_at")))).alias("from_millis"))


@query("signals", sql="SELECT id, id::BIGINT % 2 = 0 AS readable FROM signals")
def json_text(v):
    """Whether payloads read as JSON; every other one is broken first."""
    broken = F.when(F.col("id").cast("long") % 2 == 0, F.lit('{"a": [1, null]}')).otherwise(F.lit("{broken"))
    return v.signals.select("id", X.scalar.json_text(broken).isNotNull().alias("readable"))


@query("tasks", "workers", sql=f", {OFFERS}, {SLOTS} SELECT slot, worker_id FROM slots WHERE worker_id::BIGINT % 4 <> 0")
def slots_left(v):
    """Slots without those of workers that have left."""
    gone = v.workers.where(F.col("id").cast("long") % 4 == 0).select(F.col("id").alias("worker_id"))
    return M.deregistered(_slots(v), gone).select("slot", "worker_id")


def _subscribed(v):
    return v.workers.select(F.col("id").alias("worker_id"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("queues"), F.col("concurrency").alias("free"))


@query("tasks", "workers", sql=f""", {OFFERS}, slots AS (SELECT w.id AS worker_id, q AS queue_name, p::INTEGER AS partition_id FROM workers w, unnest(['1-URGENT', '2-HIGH']) a(q), range(4) b(p)),
 ot AS (SELECT *, row_number() OVER (PARTITION BY queue_name, partition_id ORDER BY seq, id) AS k FROM offers),
 os AS (SELECT *, row_number() OVER (PARTITION BY queue_name, partition_id ORDER BY worker_id) AS k FROM slots)
 SELECT id, worker_id, queue_name, partition_id FROM (SELECT ot.id, ot.seq, os.worker_id, ot.queue_name, ot.partition_id FROM ot JOIN os USING (queue_name, partition_id, k))
 QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY seq, id) = 1""")
def match_workers_once(v):
    """One round: every worker waits on all its queues' partitions and takes one task."""
    return M.match_workers(_offers(v), _subscribed(v), 4, rounds=1).select("id", "worker_id", "queue_name", "partition_id")


@query("tasks", sql="SELECT id || '-run' AS task_run_id, 0 AS seq, 2 AS level, 'task ' || id AS message FROM tasks WHERE status = 'RUNNING'")
def handler_logs(v):
    from ..udf import handler_logs as entries
    from ..udf import run_handlers

    todo = v.tasks.where("status = 'RUNNING'").select(F.col("id").alias("task_id"), F.concat("id", F.lit("-run")).alias("run_id"))
    return entries(run_handlers(todo, lambda context: context.info(f"task {context.task_id}"), at_once=4)).select("task_run_id", "seq", "level", "message")


@query("task_events", sql="""SELECT 'tasktime_' || m || CASE WHEN q = '' THEN '' ELSE '{queue="' || q || '"}' END || ' ' || count(*) AS line FROM (
  SELECT CASE new_status WHEN 1 THEN 'tasks_created_total' WHEN 4 THEN 'tasks_completed_total' WHEN 5 THEN 'tasks_failed_total' WHEN 6 THEN 'tasks_retried_total' END AS m,
    CASE WHEN new_status = 1 THEN queue_name ELSE '' END AS q FROM task_events) WHERE m IS NOT NULL GROUP BY m, q""")
def metric_text(v):
    return N.exposition(N.event_counters(v.task_events), "tasktime_")


@query("workers", sql="SELECT count(DISTINCT node_id) AS value FROM workers")
def cluster_members(v):
    return C.members(_nodes(v))


@query("tasks", "workers", sql=f", {VNODES}, {OWNED} SELECT t.queue_name, count(*) AS value FROM tasks t JOIN owner o USING (queue_name, partition_id) WHERE o.node <> 'node-1' GROUP BY t.queue_name")
def tasks_forwarded(v):
    return C.forwarded(v.tasks, _nodes(v), "node-1")


@query("signals", sql="""SELECT consumer, sent, greatest(0, sent - 4096 - read) AS missed, sent - greatest(read, sent - 4096) AS got FROM (
  SELECT consumer, sent, coalesce(lag(sent) OVER (PARTITION BY consumer ORDER BY sent), 0) AS read FROM (SELECT DISTINCT 'c' || (id::BIGINT % 3) AS consumer, id::BIGINT * 5 AS sent FROM signals WHERE id::BIGINT % 7 = 0))""")
def lagging_consumers(v):
    n = F.col("id").cast("long")
    polls = v.signals.where(n % 7 == 0).select(F.concat(F.lit("c"), (n % 3).cast("string")).alias("consumer"), (n * 5).alias("sent")).distinct()
    return E.lagging(polls)


@query()
def forward_calls(v):
    """Calls to other nodes made up from signals; a circuit opens after three failures in a row."""
    n = F.col("id").cast("long")
    calls = v.signals.select(F.concat(F.lit("node-"), (n % 3).cast("string")).alias("addr"), n.alias("seq"), (n * 900).alias("at_ms"), (n % 5 < 2).alias("first_ok"), (n % 11 == 0).alias("retry_ok"))
    return C.forward_calls(calls)
