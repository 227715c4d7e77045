import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tasklathe.llm import bin_packing as B
from tasklathe.llm import registry
from tasklathe.llm.sparkio import table


def plain_best_fit(items, capacity):
    bins, placed = [], {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = [(left, i) for i, left in enumerate(bins) if size <= left]
        if fits:
            at = min(fits)[1]
        else:
            at = len(bins)
            bins.append(capacity)
        bins[at] -= size
        placed[name] = at
    return placed


@given(st.lists(st.integers(1, 60), max_size=80), st.integers(60, 90))
@settings(max_examples=80, deadline=None)
def test_same_as_trying_every_bin(sizes, capacity):
    items = [(s, i) for i, s in enumerate(sizes)]
    assert B.best_fit_decreasing(items, capacity) == plain_best_fit(items, capacity)


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=200))
@settings(max_examples=80, deadline=None)
def test_tree_is_a_sorted_set(steps):
    tree, held = B.AATree(), set()
    for add, k in steps:
        if add and (k,) not in held:
            tree.add((k,))
            held.add((k,))
        elif not add:
            tree.remove((k,))
            held.discard((k,))
        assert tree.at_least((k,)) == min((h for h in held if h >= (k,)), default=None)


def test_oversized_item_gets_a_bin():
    assert B.best_fit_decreasing([(100, "a"), (3, "b"), (4, "c")], 10) == {"a": 0, "c": 1, "b": 1}


@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_packing_into_bins_keeps_all_items(sizes, bins):
    placed = B.pack_into(list(Counter(sizes).items()), bins)
    assert Counter({s: sum(n for _, n in parts) for s, parts in placed}) == Counter(sizes)
    assert {at for _, parts in placed for at, _ in parts} <= set(range(bins))


def test_shards_are_those_of_plain_best_fit(spark, sf_dir):
    """All groups of the whole table, one by one, at the capacity that the packing has come to."""
    sizes = Counter()
    for r in table(spark, sf_dir, "documents").collect():
        sizes[r.text or ""] += len((r.text or "").encode()) + 1
    load = Counter()
    for r in registry.op7_sharding(spark, sf_dir).collect():
        load[r.shard] += r.size
    placed = B.pack_into(list(Counter(sizes.values()).items()), 16)
    ours = Counter()
    for size, parts in placed:
        for at, n in parts:
            ours[at] += size * n
    assert load == ours
    fair = sum(load.values()) / 16
    rest = [(s, t) for t, s in sizes.items()]
    if max(sizes.values()) <= fair:
        plain = Counter()
        for text, at in plain_best_fit(rest, max(load.values())).items():
            plain[at] += sizes[text]
        assert plain == loads_of(rest, max(load.values())) and len(plain) <= 16


def loads_of(items, capacity):
    placed, size = B.best_fit_decreasing(items, capacity), {name: s for s, name in items}
    out = Counter()
    for name, at in placed.items():
        out[at] += size[name]
    return out


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(i, 3, "a", "b", "c", 9) for i in range(20)], "doc_id long, size int, `__size` string, shard string, slot string, `__pack_rank` int")
    got = B.assign(frame, F.col("size"), F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))), 4)
    assert got.columns == ["doc_id", "size", "__size", "shard", "slot"] and sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = registry.op7_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, home = Counter(), {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert home.setdefault(raw, r.shard) == r.shard
        load[r.shard] += r.size
    slots = Counter(r.shard for r in rows)
    assert {(r.shard, r.slot) for r in rows} == {(s, i) for s, n in slots.items() for i in range(n)}
    assert set(load) <= set(range(16)) and max(load.values()) < 1.2 * sum(load.values()) / 16


def test_hot_group_null_and_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(i % 50, "hot" * 10) for i in range(300)] + [(None, None), (None, ""), (7, None)] + [(i, "x" * rng.randrange(1, 90)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    got = B.assign(frame, F.length(text) + 1, F.unhex(F.md5(text.cast("binary"))), 4).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.text and r.text.startswith("hot")}) == 1
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text or "") + 1
    others = sorted(sizes.values())[:-1]
    assert len(sizes) == 4 and max(others) - min(others) < 200
    assert {(r.shard, r.slot) for r in got} == {(s, i) for s, n in Counter(r.shard for r in got).items() for i in range(n)}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert B.assign(frame, F.lit(1), F.unhex(F.md5(F.lit("a").cast("binary"))), 4).count() == 0
