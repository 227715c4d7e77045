import pytest
from pyspark.sql import functions as F

from tasklathe import functions as X
from tasklathe.schemas import LOG_LEVEL, TASK_STATUS


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_backoff_sequence_cap_and_overflow(spark):
    rows = [(i,) for i in [*range(11), 100, -1]]
    assert values(spark, X.backoff_seconds(F.col("n")), rows, "n int") == [2**i for i in range(11)] + [3600, 3600]
    assert values(spark, X.backoff_seconds(F.col("n"), 0), rows, "n int") == [0] * 13
    assert values(spark, X.backoff_seconds(F.col("n"), 5, 60), [(1,), (9,)], "n int") == [10, 60]


def test_reconnect_jitter_stays_within_a_tenth(spark):
    plain = values(spark, X.reconnect_ms(F.col("n")), [(i,) for i in range(12)], "n int")
    assert plain[:3] == [100, 200, 400] and plain[-1] == 30_000
    told = values(spark, X.reconnect_ms(F.col("n"), jitter=0.1, seed=3), [(i,) for i in range(12)], "n int")
    assert all(p <= t <= 1.1 * p for p, t in zip(plain, told, strict=True))


def test_partitions_are_stable_in_range_and_spread(spark):
    rows = [("q", f"task-{i}") for i in range(100)]
    for f in (X.partition_of, X.portable_partition_of):
        got = values(spark, f(F.col("q"), F.col("id"), 4), rows, "q string, id string")
        assert got == values(spark, f(F.col("q"), F.col("id"), 4), rows, "q string, id string")
        assert set(got) == {0, 1, 2, 3}
        assert set(values(spark, f(F.col("q"), F.col("id"), 1), rows, "q string, id string")) == {0}


def test_codes_round_trip(spark):
    names = [(n,) for n in TASK_STATUS]
    assert values(spark, X.status_name(X.status_code(F.col("s"))), names, "s string") == list(TASK_STATUS)
    assert values(spark, X.status_code(F.col("s")), [("pending",), (None,), ("X",)], "s string") == [0, 0, 0]
    assert values(spark, X.level_name(F.col("n")), [(1,), (9,), (0,)], "n int") == ["DEBUG", "INFO", "INFO"]
    assert values(spark, X.level_code(F.col("s")), [(n,) for n in LOG_LEVEL] + [("NOPE",)], "s string") == [1, 2, 3, 4, 0]


def test_liveness_limits_are_strict(spark):
    rows = [(9.0,), (10.0,), (11.0,), (29.0,), (30.0,), (31.0,), (60.0,)]
    assert values(spark, X.liveness(F.col("a")), rows, "a double") == ["Alive", "Alive", "Suspect", "Suspect", "Suspect", "Dead", "Dead"]


def test_times(spark):
    frame = spark.createDataFrame([("2024-05-01T12:00:00Z",), ("2024-05-01T14:00:00+02:00",), ("nonsense",), (None,)], "s string")
    got = [r[0] for r in frame.select(X.to_millis(X.parse_rfc3339(F.col("s")))).collect()]
    assert got == [1714564800000, 1714564800000, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        frame.select(X.parse_rfc3339(F.col("s"), strict=True)).collect()
    one = spark.createDataFrame([(1714564800123,)], "ms bigint").select(X.rfc3339(X.from_millis(F.col("ms"))), X.display_date(X.from_millis(F.col("ms"))))
    assert tuple(one.first()) == ("2024-05-01T12:00:00.123000Z", "May 1, 2024 12:00:00")


def test_relative_time(spark):
    as_of = X.moment("2024-05-01 12:00:00")
    rows = [(s,) for s in ("2024-05-01 11:59:30", "2024-05-01 11:59:00", "2024-05-01 09:30:00", "2024-04-28 12:00:00", "2024-05-01 14:00:00")]
    got = values(spark, X.relative_time(F.col("s").cast("timestamp_ntz"), as_of), rows, "s string")
    assert got == ["less than a minute ago", "1 minute ago", "2 hours ago", "3 days ago", "in 2 hours"]


def test_json(spark):
    rows = [('{"n": 3, "s": "x"}',), ("{bad",), (None,), ("[1]",)]
    assert values(spark, X.json_field(F.col("j"), "$.n", "bigint"), rows, "j string") == [3, None, None, None]
    assert values(spark, X.json_field(F.col("j"), "$.s", "bigint"), rows, "j string") == [None] * 4
    assert values(spark, X.json_text(F.col("j")), rows, "j string") == ['{"n":3,"s":"x"}', None, None, "[1]"]


def test_keys_and_wire_text(spark):
    frame = spark.createDataFrame([("node#x", "", None)], "n string, e string, z string")
    got = frame.select(X.vnode_key(F.col("n"), F.lit(7)), X.vnode_owner(X.vnode_key(F.col("n"), F.lit(7))), X.from_wire(F.col("e")), X.wire_text(F.col("z")), X.partition_key(F.lit("q"), F.lit(2)), X.short_id(F.lit("0123456789"))).first()
    assert tuple(got) == ("node#x#vn7", "node", None, "", "q:2", "01234567")
