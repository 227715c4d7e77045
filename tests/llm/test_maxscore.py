import math
import random

import pytest

from tasklathe.llm import maxscore as M
from tasklathe.llm import registry
from tasklathe.llm.sparkio import table


def brute(rows, k, every):
    vectors = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(key, [math.floor(1024 * x) for x in v])
    out = []
    for q in sorted(vectors):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), c) for c, v in vectors.items() if c != q)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return out


def ours(spark, rows, k=10, every=100):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = M.quantised(frame, "vec_id", "embedding")
    return sorted(tuple(r) for r in M.top_k(v, v.where(f"vec_id % {every} = 0"), k).collect())


@pytest.mark.parametrize("spread", [0.02, 0.5, 300.0])
def test_random(spark, monkeypatch, spread):
    monkeypatch.setattr(M, "SHARD_ROWS", 100)
    monkeypatch.setattr(M, "CHUNK_QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, spread) * (j < 3 or rng.random() < 0.3) for j in range(12)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]
    assert ours(spark, rows, every=50) == brute(rows, 10, 50)


def test_edges(spark):
    rows = [(0, [1.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (6, []), (None, [1.0, 1.0]), (7, [-0.0004, 2.0]), (100, [0.0, 0.0])]
    assert ours(spark, rows) == brute(rows, 10, 100)


def test_huge_components_stay_exact(spark):
    rows = [(i, [1e3 + i, -3e2 * i, 2e3]) for i in range(300)]
    assert ours(spark, rows) == brute(rows, 10, 100)


def test_empty_and_no_queries(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, [1.0])]) == []
    assert ours(spark, [(0, [1.0])]) == []


def test_pruning_happens():
    import numpy as np

    rng = np.random.default_rng(1)
    terms = (rng.normal(0, 30, (5000, 32)) * (np.arange(32) < 4) + rng.normal(0, 1, (5000, 32))).astype(np.int64)
    shard = M.Shard(np.arange(5000), terms)
    seen = []
    plain = shard.traverse
    shard.traverse = lambda q, t, rows: (seen.append(len(t) * len(np.arange(5000)[rows])), plain(q, t, rows))[1]
    ids, scores = shard.top(0, terms[0], 10)
    full = terms @ terms[0]
    full[0] = -(10**9)
    assert sorted(scores)[::-1] == sorted(full)[::-1][:10] and sum(seen) < 0.5 * 5000 * 32


def test_repeated_identifiers_count_once_with_their_best(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 7)
    rng = random.Random(2)
    rows = [(i % 40, [float(rng.randrange(-5, 6)) for _ in range(3)]) for i in range(120)]
    rows += rows[:30]
    best = {}
    for q, x in rows:
        for c, y in rows:
            if q % 10 == 0 and c != q:
                score = sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(x, y, strict=True))
                best[q, c] = max(score, best.get((q, c), score))
    want = []
    for q in range(0, 40, 10):
        ranked = sorted((-s, c) for (of, c), s in best.items() if of == q)[:10]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(ranked, 1)]
    assert ours(spark, rows, every=10) == want


def test_other_columns_do_not_matter(spark):
    frame = spark.createDataFrame([(0, [1], 5, 6, 7), (1, [2], 5, 6, 7)], "vec_id long, terms array<long>, score int, rank int, query_id int")
    assert [tuple(r) for r in M.top_k(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 2)]


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert sorted(map(tuple, registry.op3_maxscore_topk(spark, sf_dir).collect())) == brute(rows, 10, 100)
