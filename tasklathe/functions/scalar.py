"""Scalar functions: backoff, hashing, codes, time, JSON and key composition.

All are column expressions of built-in functions, so they stay in generated code.
Time never comes from a clock: functions that need it take it as a column.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LOG_LEVEL, TASK_STATUS

LEASE_GRACE_SECONDS = 30
HEARTBEAT_LEASE_SECONDS = 60
SUSPECT_AFTER, DEAD_AFTER = 10, 30


def moment(at: Column | datetime | str) -> Column:
    """A point in time as a column: strings and datetimes become timestamps without time zone."""
    if isinstance(at, Column):
        return at
    text = at if isinstance(at, str) else at.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def plus_seconds(at: Column, seconds: Column | int) -> Column:
    """``at`` moved by whole seconds, in its own type."""
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return at + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def backoff_seconds(attempt: Column, base: int = 1, cap: int = 3600) -> Column:
    """Retry delay ``min(base * 2^attempt, cap)``; a negative attempt reads as a huge one, as an unsigned number would."""
    grown = F.when(attempt < 0, F.lit(0.0 if base == 0 else float(cap))).otherwise(F.lit(float(base)) * F.pow(F.lit(2.0), attempt))
    return F.least(grown, F.lit(float(cap))).cast("long")


def reconnect_ms(attempt: Column, base: int = 100, cap: int = 30_000, jitter: float = 0.0, seed: int = 0) -> Column:
    """Client reconnect delay ``min(base * 2^attempt, cap)``, up to ``jitter`` more (0.1 in clients)."""
    plain = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(cap)))
    return (plain * (1 + jitter * F.rand(seed)) if jitter else plain).cast("long")


def partition_of(queue: Column, key: Column, partitions: int) -> Column:
    """Partition of a task, from 0 to partitions - 1: the same for the same queue and id, and spread over ids."""
    return F.pmod(F.xxhash64(queue, key), F.lit(partitions)).cast("int")


def portable_hash(text: Column) -> Column:
    """32 bits of a digest, equal in any engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def portable_partition_of(queue: Column, key: Column, partitions: int) -> Column:
    return (portable_hash(F.concat(queue, F.lit("/"), key)) % partitions).cast("int")


def _case(value: Column, table: dict, other: Column) -> Column:
    (first, got), *rest = table.items()
    out = F.when(value == first, F.lit(got))
    for k, v in rest:
        out = out.when(value == k, F.lit(v))
    return out.otherwise(other)


def status_code(status: Column) -> Column:
    """Wire number of a status name; 0 for any other (names are case-sensitive)."""
    return _case(status, TASK_STATUS, F.lit(0))


def status_name(code: Column) -> Column:
    """Status name of a wire number; null for 0 and any other."""
    return _case(code, {v: k for k, v in TASK_STATUS.items()}, F.lit(None).cast("string"))


def level_code(level: Column) -> Column:
    """Wire number of a level name; 0 for any other."""
    return _case(level, LOG_LEVEL, F.lit(0))


def level_name(code: Column) -> Column:
    """Level name of a wire number; INFO for any other, as on ingestion."""
    return _case(code, {v: k for k, v in LOG_LEVEL.items()}, F.lit("INFO"))


def parse_rfc3339(text: Column, strict: bool = False) -> Column:
    """A timestamp; a bad value gives null, or with ``strict`` an error."""
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def to_millis(at: Column) -> Column:
    """Milliseconds since the epoch; timestamps without time zone count as UTC."""
    return F.floor((F.unix_micros(at.cast("timestamp"))) / 1000).cast("long")


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def json_text(value: Column) -> Column:
    """Canonical text of a JSON value; null where it isn't valid JSON."""
    return F.to_json(F.try_parse_json(value))


def json_field(value: Column, path: str, kind: str = "string") -> Column:
    """A typed member of a JSON value; null where it is missing, invalid or of another kind."""
    return F.try_variant_get(F.try_parse_json(value), path, kind)


def short_id(key: Column) -> Column:
    return F.substring(key, 1, 8)


def display_date(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy HH:mm:ss")


def relative_time(at: Column, as_of: Column) -> Column:
    """Rounded distance from ``as_of`` in words, such as ``5 minutes ago``; whole days beyond a day."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    size = F.abs(seconds)
    ladder = F.when(size < 60, F.lit("less than a minute"))
    for limit, unit, name in ((3600, 60, "minute"), (86_400, 3600, "hour"), (None, 86_400, "day")):
        n = F.floor(size / unit)
        words = F.concat(n.cast("string"), F.when(n == 1, f" {name}").otherwise(f" {name}s"))
        ladder = ladder.when(size < limit, words) if limit else ladder.otherwise(words)
    return F.when(seconds >= 0, F.concat(ladder, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), ladder))


def wire_text(value: Column) -> Column:
    """Null to the empty string, as on the wire."""
    return F.coalesce(value, F.lit(""))


def from_wire(value: Column) -> Column:
    """The empty string to null."""
    return F.nullif(value, F.lit(""))


def liveness(age_seconds: Column) -> Column:
    """``Dead`` beyond 30 s without a heartbeat, ``Suspect`` beyond 10 s, else ``Alive``; the limits themselves are inside."""
    return F.when(age_seconds > DEAD_AFTER, "Dead").when(age_seconds > SUSPECT_AFTER, "Suspect").otherwise("Alive")


def lease_end(start: Column, timeout_seconds: Column) -> Column:
    return plus_seconds(start, timeout_seconds + LEASE_GRACE_SECONDS)


def partition_key(queue: Column, partition: Column) -> Column:
    return F.concat_ws(":", queue, partition.cast("string"))


def vnode_key(node: Column, number: Column) -> Column:
    return F.concat(node, F.lit("#vn"), number.cast("string"))


def vnode_owner(key: Column) -> Column:
    """The node of a virtual node's key: what stands before the first ``#``, so a node id must not hold one."""
    return F.element_at(F.split(key, "#"), 1)


def stable_id(*parts: Column) -> Column:
    """A reproducible identifier of its parts, in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 32)
