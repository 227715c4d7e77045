"""Session helpers shared by the operators: durable cuts that leave nothing behind, partition counts, tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: Spark's own setting by which an action removes its shuffle files when it ends.
_REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``, which executors share.

    Where that is unset, a session within one JVM (tests) gets a temporary folder;
    on a cluster that is an error, as executors couldn't read such a folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            if not _OWN_DIR:
                _OWN_DIR.append(tempfile.mkdtemp(prefix="checkpoints-"))
            configured = _OWN_DIR[0]
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files as soon as they have ended."""
    before = spark.conf.get(_REMOVAL, "false")
    spark.conf.set(_REMOVAL, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVAL, before)


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage.

    A lost executor costs nothing: the data is read from the shared folder.  The
    shuffle files that led to it go at once; ``release`` removes the data.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with _shuffles_removed(spark):
        kept = df.select("*").checkpoint(eager=True)
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    kept._stands_in = file.get() if file.isDefined() else None
    return kept


def collected(df: DataFrame) -> list[Row]:
    """The rows of a small result; the shuffle files that led to it go at once."""
    with _shuffles_removed(df.sparkSession):
        return df.select("*").collect()


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; ``release`` removes the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.select("*").write.parquet(path)
    kept = spark.read.parquet(path)
    kept._stands_in = path
    return kept


def release(*frames: DataFrame) -> None:
    """Delete what ``durable`` or ``rewritten`` wrote for these frames; nothing may read them afterwards."""
    for frame in frames:
        path = getattr(frame, "_stands_in", None)
        if path:
            context = frame.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            frame._stands_in = None


def dealt_anew(key: str) -> Column:
    """The long column ``key``, such that Spark doesn't know it as the key by which its rows lie already.

    A join then has an exchange of its own on that side, which lets Spark split a
    skewed key, and an aggregate by this and further columns spreads by all of them.
    """
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def width(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions of the session, ``least`` at the minimum."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by a path that only Spark need understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
