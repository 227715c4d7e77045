"""Reads, analytics and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import reads as R
from ..sources.fixtures import AS_OF
from .registry import query

COUNTS = """count(*) AS total, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running,
  count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status IN ('FAILED', 'DEAD_LETTER')) AS failed"""
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("tasks", sql=f"SELECT queue_name, {COUNTS} FROM tasks GROUP BY queue_name")
def queue_overview(v):
    return R.queue_overview(v.tasks)


@query("tasks", sql=f"SELECT {COUNTS} FROM (SELECT * FROM tasks ORDER BY created_at DESC, id DESC LIMIT 500)")
def stats_cards_top500(v):
    return R.stats_cards(v.tasks)


SHARES = ", ".join(f"{c}::DOUBLE / total * 100 AS {c}_pct" for c in ("pending", "running", "completed", "failed"))


@query("tasks", sql=f"SELECT queue_name, {SHARES} FROM (SELECT queue_name, {COUNTS} FROM tasks GROUP BY queue_name)")
def queue_share_pct(v):
    return R.queue_shares(v.tasks)


@query("tasks", sql="SELECT queue_name, count(*) AS count FROM tasks WHERE status = 'PENDING' GROUP BY queue_name")
def pending_by_queue(v):
    return R.pending_by_queue(v.tasks)


@query("tasks", sql="SELECT queue_name, count(*) FILTER (WHERE status = 'PENDING') AS count FROM tasks GROUP BY queue_name")
def pending_with_zeros(v):
    return R.pending_with_zeros(v.tasks)


@query("tasks", sql="SELECT DISTINCT queue_name FROM tasks")
def distinct_queues(v):
    return R.queues(v.tasks)


def _active(v):
    return R.with_load(v.workers, R.held_tasks(v.runs))


ACTIVE = """held AS (SELECT worker_id, count(DISTINCT task_id) AS n FROM runs WHERE status = 'RUNNING' GROUP BY worker_id),
 active AS (SELECT w.*, coalesce(h.n, 0) AS n FROM workers w LEFT JOIN held h ON w.id = h.worker_id)"""


@query("workers", "runs", sql=f", {ACTIVE} SELECT coalesce(sum(n), 0)::BIGINT AS active_tasks, sum(concurrency)::BIGINT AS concurrency, count(*) AS workers FROM active")
def worker_totals(v):
    return R.worker_totals(_active(v))


@query("workers", "runs", sql=f", {ACTIVE} SELECT id, (concurrency - n)::INTEGER AS free FROM active")
def free_slots(v):
    return _active(v).select("id", "free")


@query("runs", "tasks", sql="SELECT task_id, min(worker_id) AS worker_id FROM runs WHERE status = 'RUNNING' AND task_id IN (SELECT id FROM tasks WHERE status = 'RUNNING') GROUP BY task_id")
def task_holders(v):
    return R.holders_of(R.held_tasks(v.runs), v.tasks.where("status = 'RUNNING'").select(F.col("id").alias("task_id")))


@query("tasks", sql="SELECT * FROM tasks WHERE id = '17'")
def get_task(v):
    return R.by_id(v.tasks, "17")


@query("tasks", sql="SELECT * FROM tasks ORDER BY created_at DESC, id DESC LIMIT 50")
def list_tasks_all(v):
    return R.list_tasks(v.tasks)


@query("tasks", sql="SELECT * FROM tasks WHERE queue_name = '1-URGENT' ORDER BY created_at DESC, id DESC LIMIT 50")
def list_tasks_by_queue(v):
    return R.list_tasks(v.tasks, queue="1-URGENT")


@query("tasks", sql="SELECT * FROM tasks WHERE queue_name = '2-HIGH' AND status = 'FAILED' ORDER BY created_at DESC, id DESC LIMIT 50")
def list_tasks_by_status(v):
    return R.list_tasks(v.tasks, queue="2-HIGH", status=5)


@query("tasks", sql="SELECT * FROM tasks ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 25")
def list_tasks_page2(v):
    page, _ = R.page_of_tasks(v.tasks, size=25, token="25")
    return page


@query("tasks", sql="SELECT * FROM tasks WHERE contains(lower(task_name), 'sk-3') AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1996-01-01'")
def search_tasks(v):
    return R.tasks_named(v.tasks, "SK-3", "1995-01-01 00:00:00", "1996-01-01 00:00:00")


@query("runs", sql="SELECT * FROM runs WHERE task_id = '17' ORDER BY attempt_number DESC")
def runs_for_task(v):
    return R.runs_of(v.runs, "17")


@query("runs", sql="SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt_number DESC) = 1")
def latest_run(v):
    return R.latest_runs(v.runs)


@query("runs", sql="SELECT task_id, error_message FROM runs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt_number DESC) = 1")
def latest_error(v):
    return R.latest_errors(v.runs)


@query("signals", sql="SELECT * FROM signals WHERE task_id = '5' AND status = 'PENDING' ORDER BY created_at, id")
def signals_fifo(v):
    return R.signals_of(v.signals, "5", "PENDING")


@query("task_events", sql="SELECT * FROM task_events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_events_200(v):
    return R.recent(v.task_events, 200, "ts")


@query("logs", sql="SELECT * FROM logs WHERE task_run_id = '3' AND id > 3000 ORDER BY timestamp_ms, id LIMIT 1000")
def run_logs_after_id(v):
    return R.run_logs(v.logs, "3", 3000)


@query("tasks", sql="SELECT * FROM tasks WHERE status = 'PENDING' AND (scheduled_at IS NULL OR scheduled_at <= $AS_OF)")
def eligible_tasks(v):
    return R.eligible(v.tasks, AS_OF)


@query("runs", sql="SELECT * FROM runs WHERE status = 'RUNNING' AND lease_expires_at < $AS_OF")
def expired_leases(v):
    return R.expired_leases(v.runs, AS_OF)


@query("tasks", sql="SELECT * FROM tasks WHERE status = 'RETRY' AND scheduled_at <= $AS_OF")
def due_retries(v):
    return R.due_retries(v.tasks, AS_OF)


@query("tasks", sql="SELECT * FROM tasks WHERE status = 'RETRY' AND scheduled_at IS NULL")
def unscheduled_retries(v):
    return R.unscheduled_retries(v.tasks)


@query("tasks", sql="SELECT * FROM tasks WHERE status = 'FAILED' AND attempt_count >= max_retries")
def exhausted_failed(v):
    return R.exhausted(v.tasks)


@query("tasks", "runs", sql="SELECT t.* FROM tasks t WHERE status = 'DISPATCHING' AND id NOT IN (SELECT task_id FROM runs WHERE status = 'RUNNING')")
def orphan_dispatching(v):
    return R.orphans(v.tasks, v.runs)


@query("signals", "tasks", sql="SELECT s.* FROM signals s JOIN tasks t ON s.task_id = t.id WHERE t.status NOT IN ('COMPLETED', 'FAILED', 'DEAD_LETTER', 'CANCELLED')")
def signals_accepted(v):
    return R.split_signals(v.signals, v.tasks)[0]


@query("signals", "tasks", sql="SELECT s.*, CASE WHEN t.id IS NULL THEN 'NOT_FOUND' ELSE 'FAILED_PRECONDITION' END AS reason FROM signals s LEFT JOIN tasks t ON s.task_id = t.id WHERE t.id IS NULL OR t.status IN ('COMPLETED', 'FAILED', 'DEAD_LETTER', 'CANCELLED')")
def signals_rejected(v):
    return R.split_signals(v.signals, v.tasks)[1]


@query("runs", sql="SELECT date_trunc('day', completed_at)::TIMESTAMP AS start, count(*) AS completed FROM runs WHERE status = 'COMPLETED' GROUP BY 1")
def throughput_by_day(v):
    return R.throughput(v.runs)


@query("tasks", sql="SELECT status, CASE status WHEN 'PENDING' THEN 1 WHEN 'DISPATCHING' THEN 2 WHEN 'RUNNING' THEN 3 WHEN 'COMPLETED' THEN 4 WHEN 'FAILED' THEN 5 WHEN 'RETRY' THEN 6 WHEN 'DEAD_LETTER' THEN 7 WHEN 'CANCELLED' THEN 8 ELSE 0 END AS code, count(*) AS n FROM tasks GROUP BY status")
def status_codec(v):
    counted = v.tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("code", X.status_code(F.col("status")))
    return counted.select(X.status_name(F.col("code")).alias("status"), "code", "n")


@query("logs", sql="SELECT level, CASE level WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 ELSE 0 END AS code, count(*) AS n FROM logs GROUP BY level")
def level_codec(v):
    counted = v.logs.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("code", X.level_code(F.col("level")))
    return counted.select(X.level_name(F.col("code")).alias("level"), "code", "n")


@query("tasks", sql="SELECT id, least(power(2, attempt_count), 3600)::BIGINT AS delay, least(5 * power(2, priority * 20), 3600)::BIGINT AS capped, least(100 * power(2, attempt_count), 30000)::BIGINT AS reconnect FROM tasks")
def backoff(v):
    return v.tasks.select("id", X.backoff_seconds(F.col("attempt_count")).alias("delay"), X.backoff_seconds(F.col("priority") * 20, 5).alias("capped"), X.reconnect_ms(F.col("attempt_count")).alias("reconnect"))


@query("workers", sql="SELECT id, CASE WHEN heartbeat_age_s > 30 THEN 'Dead' WHEN heartbeat_age_s > 10 THEN 'Suspect' ELSE 'Alive' END AS liveness FROM workers")
def liveness(v):
    return v.workers.select("id", X.liveness(F.col("heartbeat_age_s")).alias("liveness"))


@query("tasks", sql="SELECT id, created_at + INTERVAL '1' SECOND * (timeout_seconds + 30) AS lease FROM tasks")
def lease_end(v):
    return v.tasks.select("id", X.lease_end(F.col("created_at"), F.col("timeout_seconds")).alias("lease"))


@query("signals", sql="SELECT id, (epoch_us(created_at) // 1000)::BIGINT AS millis, created_at::VARCHAR IS NOT NULL AS dated FROM signals")
def epoch_ms(v):
    millis = X.to_millis(F.col("created_at"))
    return v.signals.select("id", millis.alias("millis"), (X.to_millis(X.from_millis(millis)) == millis).alias("dated"))


@query("signals", sql="SELECT id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM signals")
def json_field(v):
    return v.signals.select("id", X.json_field(F.col("payload"), "$.k", "bigint").alias("k"))


@query("tasks", sql=f"SELECT id, ({HASH.format("queue_name || '/' || id")} % 4)::INTEGER AS partition_id FROM tasks")
def partition_md5(v):
    return v.tasks.select("id", X.portable_partition_of(F.col("queue_name"), F.col("id"), 4).alias("partition_id"))


@query()
def partition_xxhash(v):
    return v.tasks.select("id", X.partition_of(F.col("queue_name"), F.col("id"), 4).alias("partition_id"))


@query("signals", sql="SELECT id, substr(id, 1, 8) AS short, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS rfc3339, strftime(created_at, '%b %-d, %Y %H:%M:%S') AS shown, coalesce(payload, '') AS wire FROM signals")
def formatted(v):
    at = F.col("created_at").cast("timestamp")
    return v.signals.select("id", X.short_id(F.col("id")).alias("short"), X.rfc3339(at).alias("rfc3339"), X.display_date(at).alias("shown"), X.wire_text(F.col("payload")).alias("wire"))


@query("tasks", sql="""SELECT id, CASE WHEN s >= 0 THEN w || ' ago' ELSE 'in ' || w END AS age FROM (
  SELECT id, s, CASE WHEN abs(s) < 60 THEN 'less than a minute' WHEN abs(s) < 3600 THEN (abs(s) // 60) || CASE WHEN abs(s) // 60 = 1 THEN ' minute' ELSE ' minutes' END
    WHEN abs(s) < 86400 THEN (abs(s) // 3600) || CASE WHEN abs(s) // 3600 = 1 THEN ' hour' ELSE ' hours' END
    ELSE (abs(s) // 86400) || CASE WHEN abs(s) // 86400 = 1 THEN ' day' ELSE ' days' END END AS w
  FROM (SELECT id, (epoch_ms($AS_OF) // 1000 - epoch_ms(created_at) // 1000)::BIGINT AS s FROM tasks))""")
def relative_age(v):
    return v.tasks.select("id", X.relative_time(F.col("created_at"), X.moment(AS_OF)).alias("age"))


@query("logs", sql="SELECT id, strftime(make_timestamp(timestamp_ms * 1000), '%H:%M:%S.%g') || ' [' || level || '] ' || message AS line FROM logs")
def log_lines(v):
    from ..operators.events import log_lines as lines

    return lines(v.logs)
