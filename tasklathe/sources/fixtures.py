"""The driver's tables viewed as tasks, runs, logs, events, signals and workers.

The SQL of a view is the same in Spark and in the comparison engine; table names
stand in braces so that Spark can bind them to frames and SQL can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-15 00:00:00"

VIEWS = {
    "tasks": """
SELECT CAST(o.o_orderkey AS STRING) AS id, o.o_orderpriority AS queue_name,
  concat('task-', CAST(o.o_custkey % 7 AS STRING)) AS task_name,
  CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 4 AS INT) AS partition_id,
  CASE CAST(o.o_orderkey % 8 AS INT) WHEN 0 THEN 'PENDING' WHEN 1 THEN 'DISPATCHING'
    WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'RETRY'
    WHEN 6 THEN 'DEAD_LETTER' ELSE 'CANCELLED' END AS status,
  CAST(o.o_custkey % 10 AS INT) AS priority, 3 AS max_retries,
  CAST(coalesce(r.n, 0) AS INT) AS attempt_count,
  CAST(60 * (1 + o.o_orderkey % 5) AS INT) AS timeout_seconds,
  CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderdate + INTERVAL '30' DAY END AS scheduled_at,
  o.o_orderdate AS created_at
FROM {orders} o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) r
  ON o.o_orderkey = r.l_orderkey""",
    "runs": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(n AS STRING)) AS id,
  CAST(l_orderkey AS STRING) AS task_id, CAST(n AS INT) AS attempt_number,
  CAST(l_suppkey AS STRING) AS worker_id,
  CASE l_returnflag WHEN 'A' THEN 'COMPLETED' WHEN 'R' THEN 'FAILED' ELSE 'RUNNING' END AS status,
  CASE WHEN l_returnflag = 'R' THEN concat('err-', CAST(l_linenumber AS STRING)) END AS error_message,
  l_shipdate AS started_at,
  CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL '1' SECOND * CAST(floor(l_quantity) AS BIGINT) END AS completed_at,
  l_shipdate + INTERVAL '330' SECOND AS lease_expires_at
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber,
        l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM {lineitem}) x""",
    "logs": """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS id,
  CAST(conv_id AS STRING) AS task_run_id, CAST(1700000000000 + turn * 1000 AS BIGINT) AS timestamp_ms,
  CASE role WHEN 'system' THEN 'DEBUG' WHEN 'user' THEN 'INFO' ELSE 'WARN' END AS level,
  text AS message FROM {conversations}""",
    "task_events": """
SELECT CAST(event_id AS STRING) AS event_id, CAST(user_id AS STRING) AS task_id,
  concat('q-', CAST(user_id % 5 AS STRING)) AS queue_name, 0 AS previous_status,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4
    WHEN 'error' THEN 5 ELSE 6 END AS new_status,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('node-', CAST(event_id % 3 AS STRING)) END AS node_id,
  ts, props FROM {events}""",
    "signals": """
SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS task_id, event_type AS signal_name,
  props AS payload, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'PENDING' WHEN 1 THEN 'DELIVERED'
    ELSE 'ACKNOWLEDGED' END AS status, ts AS created_at,
  CASE WHEN event_id % 3 >= 1 THEN ts + INTERVAL '1' SECOND END AS delivered_at,
  CASE WHEN event_id % 3 = 2 THEN ts + INTERVAL '2' SECOND END AS acknowledged_at FROM {events}""",
    "workers": """
SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name,
  concat('node-', CAST(s_nationkey % 3 AS STRING)) AS node_id,
  CAST(1 + s_suppkey % 8 AS INT) AS concurrency,
  CASE WHEN s_suppkey % 7 = 0 THEN 'DISCONNECTED' ELSE 'ACTIVE' END AS status,
  CAST(s_suppkey % 45 AS INT) AS heartbeat_age_s FROM {supplier}""",
}
BASE = ("orders", "lineitem", "conversations", "events", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the Parquet tables of ``sf_dir``."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views before it as common table expressions, table names plain."""
    plain = {t: t for t in BASE}
    body = ", ".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)
    return f"WITH {body}{',' if sql.lstrip().startswith(',') else ''} {sql.lstrip().lstrip(',')}"
