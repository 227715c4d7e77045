"""Nodes of a cluster: members, tasks that go to another node, and calls behind a circuit breaker."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from .routing import owners

#: Failures that open a circuit, how long it stays open, and when a failed call is repeated.
FAILURES, RECOVERY_MS, RETRY_MS = 3, 10_000, 200
CALLS = "addr string, seq long, attempts int, outcome string, circuit string, opened int"
#: An address's calls are dealt out in blocks of some 2 ** BLOCK_BITS; rows that Python makes at a time.
BLOCK_BITS, BATCH = 16, 10_000


def members(nodes: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().agg(F.count(F.lit(1)).alias("value"))


def forwarded(tasks: DataFrame, nodes: DataFrame, own: str) -> DataFrame:
    """``queue_name``, ``value``: tasks whose partition another node than ``own`` owns."""
    elsewhere = owners(tasks, nodes).where(F.col("node") != own)
    return tasks.join(elsewhere, ["queue_name", "partition_id"]).groupBy("queue_name").agg(F.count(F.lit(1)).alias("value"))


class Circuit:
    """Closed until failures add up, then open for a while, then half open; a success closes it and forgets them."""

    def __init__(self) -> None:
        self.state, self.failures, self.last, self.opened = "closed", 0, 0, 0

    def lets(self, now: int) -> bool:
        if self.state == "open" and now - self.last >= RECOVERY_MS:
            self.state = "half-open"
        return self.state != "open"

    def tell(self, ok: bool, now: int) -> None:
        if ok:
            self.state, self.failures = "closed", 0
            return
        self.failures, self.last = self.failures + 1, now
        if self.failures >= FAILURES:
            self.opened += self.state != "open"
            self.state = "open"

    def call(self, at: int, first_ok: bool, retry_ok: bool) -> tuple[int, str]:
        """Attempts made and the outcome of one call."""
        if not self.lets(at):
            return 0, "refused"
        self.tell(first_ok, at)
        if first_ok:
            return 1, "ok"
        if not self.lets(at):
            return 1, "failed"
        self.tell(retry_ok, at + RETRY_MS)
        return 2, "ok" if retry_ok else "failed"


def block_ends(calls: list[tuple[float, bool, bool]], latest: float | None) -> Iterator[tuple[int, float | None, int, float | None, int]]:
    """What a block of calls (time, first and second try) makes of a circuit, for every state it can be in before them.

    Rows are ``start`` (failures so far, ``FAILURES`` for an open circuit), ``until``,
    and the failures, last failure and openings to which it leads.  An open circuit
    takes the first row whose ``until`` its break doesn't outlast, and stays as it
    is if there is none.  No break ends after ``latest``; None: none is open before.
    Goes backwards: the end after a call is known when the call is looked at.
    """
    ends: list[tuple[int, float | None, int]] = [(k, None, 0) for k in range(FAILURES)]
    times: list[float] = []  # negative; of the calls later than all between here and them, the nearest last
    tried: list[tuple[int, float | None, int]] = []  # the end of a circuit that is half open at those calls

    def opened(last: float) -> tuple[int, float | None, int]:
        k = bisect_right(times, -last - RECOVERY_MS) if last == last else 0
        failures, then, n = tried[k - 1] if k else (FAILURES, last, 0)
        return failures, then, n + 1

    for at, first_ok, retry_ok in reversed(calls):
        ends = [
            ends[0] if first_ok or retry_ok and k + 1 < FAILURES else opened(at) if k + 1 >= FAILURES else opened(at + RETRY_MS) if k + 2 >= FAILURES else ends[k + 2]
            for k in range(FAILURES)
        ]
        while times and times[-1] >= -at:
            times.pop()
            tried.pop()
        if at == at:
            times.append(-at)
            tried.append(ends[-1])
    for k, end in enumerate(ends):
        yield k, None, *end
    for until, end in zip(reversed(times), reversed(tried)) if latest is not None else ():
        yield FAILURES, -until, *end
        if -until >= latest:
            break


def _ends(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of ``block_ends`` for each block, whose head has the latest time of the blocks before."""
    for (addr, block), some in groupby(rows, lambda r: r[:2]):
        prior = next(some)[-1]
        calls = [(math.nan if at is None else at, first_ok, retry_ok) for _, _, _, at, first_ok, retry_ok, _ in some]
        for start, until, failures, last, n in block_ends(calls, None if prior is None else prior + RETRY_MS + RECOVERY_MS):
            yield addr, block, start, until, failures, None if last != last else last, n


def _heads(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The circuit before each block, from the rows of ``block_ends`` of an address's blocks in their order."""
    key, after = None, (0, None, 0)
    for addr, block, start, until, failures, last, n in rows:
        if (addr, block) != key:
            before = after if key is not None and addr == key[0] else (0, None, 0)
            key, after, found = (addr, block), before, False
            yield addr, block, *before
        if not found and start == before[0] and (start < FAILURES or before[1] is not None and until >= before[1] + RECOVERY_MS):
            found, after = True, (failures, last, before[2] + n)


def _outcomes(rows: Iterable[tuple]) -> Iterator[tuple]:
    """What becomes of the calls of each block, whose head has the circuit before it."""
    circuit = Circuit()
    for addr, head, seq, at, first_ok, retry_ok, failures, last, opened in rows:
        if head:
            circuit.state = "open" if failures >= FAILURES else "closed"
            circuit.failures, circuit.last, circuit.opened = failures, math.nan if last is None else last, opened
        else:
            yield addr, seq, *circuit.call(math.nan if at is None else at, first_ok, retry_ok), circuit.state, circuit.opened


def _map_rows(frame: DataFrame, f: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``f`` over each partition's rows in their order; Python holds one Arrow batch of them and of its own."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = f(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some), kinds)], schema=kinds)

    return frame.mapInArrow(run, schema)


def _in_blocks(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with the ``block`` of their address, and the blocks with the latest time before them (``prior``).

    A run is 2 ** BLOCK_BITS numbers in a row.  Runs next to each other are one block
    until they hold as many calls, so that far-apart numbers don't make a block each.
    """
    calls = calls.withColumn("run", F.shiftright("seq", BLOCK_BITS))
    before = Window.partitionBy("addr").orderBy(F.asc_nulls_last("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = calls.groupBy("addr", "run").agg(F.count(F.lit(1)).alias("n"), F.max("at_ms").alias("latest"))
    runs = runs.select("addr", "run", F.shiftright(F.coalesce(F.sum("n").over(before), F.lit(0)), BLOCK_BITS).alias("block"), F.max("latest").over(before).alias("prior"))
    of = runs.select(F.col("addr").alias("of_addr"), F.col("run").alias("of_run"), "block")
    calls = calls.join(of, F.col("addr").eqNullSafe(F.col("of_addr")) & F.col("run").eqNullSafe(F.col("of_run")))
    return calls.drop("run", "of_addr", "of_run"), runs.groupBy("addr", "block").agg(F.min("prior").alias("prior"))


def _dealt(calls: DataFrame, heads: DataFrame) -> DataFrame:
    """Calls in their order behind their block's head, blocks spread over the partitions."""
    rows = heads.withColumn("head", F.lit(True)).unionByName(calls.withColumn("head", F.lit(False)), allowMissingColumns=True)
    return rows.repartition("addr", "block").sortWithinPartitions("addr", "block", F.desc("head"), F.asc_nulls_last("seq"), "at_ms", "first_ok", "retry_ok")


def forward_calls(calls: DataFrame) -> DataFrame:
    """What becomes of calls (``addr``, ``seq``, ``at_ms``, ``first_ok``, ``retry_ok``) in their order, address by address.

    ``circuit`` is its state after the call, ``opened`` how often it has opened so
    far.  A breaker is a fold, but a block of calls can be folded for all states
    before it at once: the blocks' ends come first, then, from one address's few
    ends, the circuit before each block, then the calls.  So an address's calls are
    spread over tasks; a block holds under 131,072 if no ``seq`` of an address repeats.

    Calls of one ``seq`` go by time, then failures first.  Without a ``seq`` they
    come last; without a time they are refused by an open circuit and, if they
    open it, leave it open; a try of unknown outcome failed.  ``calls`` is read
    several times and has to be the same each time.
    """
    time = "long" if isinstance(calls.schema["at_ms"].dataType, IntegralType) else "double"  # a retry's time has to fit too
    calls = calls.select(F.col("addr").cast("string"), F.col("seq").cast("long"), F.col("at_ms").cast(time), F.col("first_ok").cast("boolean"), F.col("retry_ok").cast("boolean"))
    calls, blocks = _in_blocks(calls)
    known = _dealt(calls, blocks).select("addr", "block", "head", "at_ms", "first_ok", "retry_ok", "prior")
    ends = _map_rows(known, _ends, f"addr string, block long, start int, until {time}, failures int, last {time}, opened int")
    ends = ends.repartition("addr").sortWithinPartitions("addr", "block", "start", "until")
    heads = _map_rows(ends, _heads, f"addr string, block long, failures int, last {time}, opened int")
    return _map_rows(_dealt(calls, heads).select("addr", "head", "seq", "at_ms", "first_ok", "retry_ok", "failures", "last", "opened"), _outcomes, CALLS)
