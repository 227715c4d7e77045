import pytest
from pyspark.sql import functions as F

from tasklathe.llm import registry
from tasklathe.llm import source_mixing as M


def refill(sizes):
    """Targets by resharing round after round; sizes in source order."""
    weight = dict(zip(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], strict=True))
    goal = dict.fromkeys(sizes, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = 0.0
        for s in sorted(open_):
            goal[s] += left * weight[s] / total
        for s in sorted(open_):
            if goal[s] >= 2 * sizes[s]:
                over += goal[s] - 2 * sizes[s]
                goal[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = over
    return goal


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 7}, {"a": 5, "b": 900, "c": 40, "d": 40, "e": 0}, {f"s{i:02}": 3 + 17 * i for i in range(20)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(frame).collect()}
    assert got == pytest.approx(refill(sizes))


def test_query_meets_targets(spark, sf_dir):
    rows = registry.op8_source_mixing(spark, sf_dir).collect()
    again = registry.op8_source_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        taken = by.setdefault((r.source_size, r.target), [0])
        taken[0] += r.taken
    assert all(abs(t - goal) <= 1 for (_, goal), (t,) in by.items())


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, f"s{i % 3}" if i % 7 else None, (i * 37) % 90) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, words long")
    run = lambda: sorted(map(str, M.mix(frame, F.col("words"), M.quality(F.col("words"))).collect()))
    monkeypatch.setattr(M, "FEW", 10**9)
    whole = run()
    monkeypatch.setattr(M, "FEW", 1)
    monkeypatch.setattr(M, "CELLS", 5)
    assert run() == whole
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert run() == whole


def test_short_texts_of_one_source_against_plain_order(spark, monkeypatch):
    """All draw weights at their least, so most keys lie far out."""
    monkeypatch.setattr(M, "FEW", 10)
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").alias("source"), (F.col("id") % 9).alias("words"))
    got = {r.doc_id: r for r in M.mix(frame, F.col("words"), M.quality(F.col("words"))).collect()}
    keys = {r.doc_id: r.k for r in frame.select("doc_id", M.draw_key(F.col("doc_id"), M.quality(F.col("words"))).alias("k")).collect()}
    for source in (0, 1):
        own = sorted((r for r in got.values() if (r.doc_id % 3 > 0) == bool(source)), key=lambda r: (keys[r.doc_id], r.doc_id))
        epochs, left = divmod(round(own[0].target), own[0].source_size)
        for r in own:
            part = min(r.size, left)
            assert r.taken == epochs * r.size + part
            left -= part


def test_many_rows_alike_meet_the_target(spark, monkeypatch):
    """Null and repeated ids share one draw, and rows may be alike in everything."""
    monkeypatch.setattr(M, "FEW", 2)
    rows = [(None, "a", 3 + i % 2, "x") for i in range(500)] + [(7, "b", 5, "same")] * 300 + [(i, "c", 11, "y") for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, words long, size string")
    got = M.mix(frame, F.col("words"), F.lit(1.0)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert len(got) == 890 and all(abs(sum(t) - goal) <= 1 for (_, goal), t in by.items()) and all(r.taken <= 2 * r.size for r in got)


def test_edge_rows(spark):
    frame = spark.createDataFrame([(None, None, 0, 1), (None, None, 5, 2), (1, "a", 0, 3), (1, "a", 4, 4), (1, "a", 4, 5)], "doc_id long, source string, words long, taken int")
    got = M.mix(frame, F.col("words"), F.lit(1.0)).collect()
    assert len(got) == 5 and all(r.taken <= 2 * r.size and r.copies <= 2 for r in got)
    assert M.mix(frame.limit(0), F.col("words"), F.lit(1.0)).count() == 0


def test_documents_without_words_stand_once_an_epoch(spark):
    rows = [(1, "a", 0), (2, "a", 10), (3, "b", 0), (4, "b", 1000), (5, "c", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, words long")
    got = {r.doc_id: r for r in M.mix(frame, F.col("words"), F.lit(1.0)).collect()}
    assert {k: got[k].copies for k in (1, 3, 5)} == {1: int(got[2].target // 10), 3: int(got[4].target // 1000), 5: 0}
    assert got[1].copies == 2 and got[3].copies == 1 and not any(got[k].taken for k in (1, 3, 5))


def test_better_documents_come_first(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("words"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("q"))
    got = M.mix(frame, F.col("words"), F.col("q")).groupBy("q").agg(F.sum("taken")).collect()
    taken = {r[0]: r[1] for r in got}
    assert sum(taken.values()) == 6000 and taken[1.0] > 1.15 * taken[0.25]
