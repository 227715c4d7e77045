"""Snapshots at rest: one Parquet folder a table, written as new versions and never in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENTS, TABLES, Snapshot

#: Columns that tables are laid out by at rest, where scans prune on them.
LAYOUT = {"tasks": ("status",), "runs": ("status",), "signals": ("status",)}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    return Snapshot(**{name: read_table(spark, path, name) for name in TABLES})


def write_snapshot(snapshot: Snapshot, path: str) -> None:
    """Write every table below ``path``, which must be new."""
    for name, schema in TABLES.items():
        frame = getattr(snapshot, name).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        frame.write.partitionBy(*LAYOUT.get(name, ())).parquet(f"{path}/{name}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, partitions: int = 1, **options: str) -> DataFrame:
    """A live table over JDBC (the driver's jar must be on the class path), split by a hash of its key in ``partitions`` reads."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    source = {"runs": "task_runs", "logs": "task_logs", "dead_letters": "dead_letter_queue", "signals": "task_signals"}.get(name, name)
    if partitions == 1:
        return reader.option("dbtable", source).load()
    predicates = [f"mod(abs(hashtext(id::text)), {partitions}) = {i}" for i in range(partitions)]
    return spark.read.jdbc(url, source, predicates=predicates, properties=options)


def register_views(snapshot: Snapshot, prefix: str = "") -> None:
    """Temporary views of all tables, for queries in SQL text."""
    for name in TABLES:
        getattr(snapshot, name).createOrReplaceTempView(f"{prefix}{name}")
