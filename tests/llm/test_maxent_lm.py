import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tasklathe.llm import maxent_lm as M
from tasklathe.llm import registry
from tasklathe.llm.sparkio import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def brute(rows, learnt):
    counts = Counter(t for key, text in rows if learnt(key) for t in split(text))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for key, text in rows:
        tokens = split(text)
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        out.append((key, len(tokens), sum(counts[t] > 0 for t in tokens), total, base))
    return out


def same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True))


def key(row):
    return (row[0] is None, row[0] or 0, row[1], row[4])


def ours(frame, learnt):
    got = M.score(frame, learnt).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return sorted((tuple(r)[:5] for r in got), key=key)


def test_query_counts_and_beats_the_base(spark, sf_dir):
    learnt = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = registry.op5_maxent_lm(spark, sf_dir).collect()
    same(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(brute(rows, learnt), key=key))
    assert all(r.held_out != learnt(r.doc_id) for r in got)
    outside = [r for r in got if r.held_out]
    assert sum(r.score for r in outside) > sum(r.base_score for r in outside)


def test_rare_tokens_by_their_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "DICTIONARY_SHARE", 0.02)
    monkeypatch.setattr(M, "_SLICE", 500)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randrange(40)))) for i in range(300)]
    same(ours(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 != 0), sorted(brute(rows, lambda k: k % 3 != 0), key=key))


def test_ranges_follow_the_tokens(spark, monkeypatch):
    used, fit = [], M.fit
    monkeypatch.setattr(M, "fit", lambda docs, ranges: used.append(ranges) or fit(docs, ranges))
    monkeypatch.setattr(M.scatter, "ITEMS_A_RANGE", 100)
    rows = [(i, " ".join(f"w{(i * j) % 701}" for j in range(30))) for i in range(80)]
    same(ours(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 != 0), sorted(brute(rows, lambda k: k % 3 != 0), key=key))
    assert used[0] >= sum(len(split(text)) for _, text in rows) / 100 > 4


def test_edge_rows(spark):
    rows = [(None, None), (None, "a b"), (1, ""), (1, "a b"), (1, "a b"), (2, "z " * 3000), (3, "É\vÉ é")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    same(ours(frame, F.lit(True)), sorted(brute(rows, lambda k: True), key=key))
    same(ours(frame, F.lit(False)), sorted(brute(rows, lambda k: False), key=key))
    assert M.score(frame.limit(0), F.lit(True)).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(0, 3, (M.FEATURES, M.CLASSES)).astype(np.float32)
    counts = M.Counts(1, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, 0)
    at = np.array([0, 5])
    total = np.zeros(5)
    for c in range(M.CLASSES):
        classes = np.arange(M.TYPES) % M.CLASSES
        model = M.Model(counts, np.where(np.arange(M.TYPES) == 7, c, classes), weights, np.zeros(M.CLASSES, dtype=np.float32), np.zeros(M.CLASSES))
        total += 10 ** model.log10_classes(np.full(5, 7), at)
    assert np.allclose(total, 1, atol=1e-4)


@given(st.lists(st.integers(0, 2**40), unique=True, max_size=60), st.lists(st.integers(0, 2**40), max_size=60))
@settings(max_examples=60, deadline=None)
def test_lookup(codes, asked):
    codes = np.sort(np.array(codes, dtype=np.uint64))
    asked = np.array(asked + codes.tolist(), dtype=np.uint64)
    want = [int(np.searchsorted(codes, a)) if a in codes else -1 for a in asked]
    assert M.Lookup(codes)(asked).tolist() == want


def test_likely_next_words_of_one_class(spark, monkeypatch):
    monkeypatch.setattr(M, "CLASSES", 1)
    texts = ["ka lo", "mi su"] * 400
    frame = spark.createDataFrame([*enumerate(texts), (-1, "ka lo"), (-2, "ka su")], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score(frame, F.col("doc_id") >= 0).where("doc_id < 0").collect()}
    assert math.isclose(got[-1].base_score, got[-2].base_score)
    assert got[-1].score > got[-2].score + 0.5


def test_tree_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    codes = np.arange(700, dtype=np.uint64)
    counts = M.Counts(1, codes, rng.integers(1, 9, 700), np.full(700, -1), 0, 0)
    leaves = 700 + M.ENDINGS
    belongs = rng.integers(0, M.CLASSES, leaves)
    mass = rng.pareto(0.7, leaves) + 1
    at, code = np.array([0, 4]), np.arange(4, dtype=np.uint64)
    for weights in (np.zeros(1 << 16, dtype=np.float32), rng.normal(0, 2, 1 << 16).astype(np.float32)):
        model = M.Model(counts, belongs, weights, weights, np.zeros(M.CLASSES), M.grow(mass, belongs), weights, np.zeros(M.ENDINGS))
        told = np.array([model.log10_inside(np.full(4, leaf), code, at) for leaf in range(leaves)])
        for c in range(M.CLASSES):
            assert np.allclose((10 ** told[belongs == c]).sum(axis=0), 1, atol=1e-4)
        if not weights.any():
            assert np.allclose(10 ** told[:, 0], mass / np.bincount(belongs, weights=mass)[belongs], rtol=1e-3)
