"""Exact top-k inner-product search with MaxScore over sharded postings.

Method.  A vector's dimensions are terms; its quantised component is the term's
weight.  A shard of candidates keeps one posting list per term with the largest
and smallest weight in it, so a query term's contribution has an upper bound.
For each query the terms are ordered by bound.  The largest possible score of a
candidate that only has the terms after some point is the sum of their bounds;
as long as that is below the k-th best score known, these terms are
non-essential: they can't bring in a candidate alone.  Essential postings are
traversed and give partial scores; a candidate is probed in the other terms, one
after another from the largest bound, only while its partial score plus the
bounds still to come can reach the k-th best score.  The threshold starts from
what a task's earlier shards have found, or from a first sample scored in full,
and rises as candidates finish; ties at it stay competitive.  Shards' lists are
merged by score and identifier.

Scores are integers and exact.  Candidates stay where they are: a chunk of
queries, bounded in size, goes to every task, which turns its rows into shards
one after another and hands in the best of all of them.  More queries are more
chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sparkio import durable, release

#: Candidates in a shard at most, and queries in a chunk, about.
SHARD_ROWS, CHUNK_QUERIES = 8192, 4096
#: Candidates of a shard that are scored in full before any is pruned.
FIRST = 64
SCALE = 1024

_FOUND = "query_id long, vec_id long, score long"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``terms`` (array of floor(1024 * x)) of the vectors that take part."""
    x = F.col("x")
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & x.isNotNull())
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return whole.where(finite).select("vec_id", F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v)).alias("terms"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of terms as an integer matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, np.arange(len(flat)) - starts] = flat
    return out


class Shard:
    """Postings of one shard's candidates, term by term."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(terms[order].T)  # term by candidate
        self.repeats = len(ids) > 1 and bool((self.ids[1:] == self.ids[:-1]).any())
        self.most = self.postings.max(axis=1) if len(ids) else np.zeros(terms.shape[1], dtype=np.int64)
        self.least = self.postings.min(axis=1) if len(ids) else self.most
        # Products and sums below 2**53 are exact in doubles, where traversal is a matrix product.
        peak = int(np.abs(self.postings).max(initial=0))
        self.exact = self.postings.astype(np.float64) if peak < 2**20 else None

    def traverse(self, query: np.ndarray, terms: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        """Sum of the given terms' contributions for the given candidates."""
        if self.exact is not None and int(np.abs(query).max(initial=0)) < 2**20 and len(query) < 2**12:
            return (query[terms].astype(np.float64) @ self.exact[terms][:, rows]).astype(np.int64)
        wide = (self.postings[terms][:, rows].astype(object) * query[terms].astype(object)[:, None]).sum(axis=0)
        return np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in np.atleast_1d(wide)], dtype=np.int64)

    def top(self, query_id: int, query: np.ndarray, k: int, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of the k best candidates other than the query, smaller identifiers first among ties.

        With ``known``, a k-th best score found elsewhere, candidates below it may be left out.
        """
        own = self.ids == query_id
        everything = np.arange(len(query))
        if self.repeats:  # an identifier counts once, with its best score
            rows = np.flatnonzero(~own)
            return _best(self.ids[rows], self.traverse(query, everything, rows), k)
        bounds = np.maximum(query * self.most, query * self.least)
        order = np.argsort(-bounds, kind="stable")
        ahead = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])  # from this term on
        head = np.flatnonzero(~own[:FIRST])
        scores = self.traverse(query, everything, head)
        rest = np.flatnonzero(~own)
        rest = rest[rest >= FIRST]
        threshold = known
        if len(scores) >= k:
            sample = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            threshold = sample if known is None else max(known, sample)
        if threshold is None:
            return _best(self.ids[np.concatenate([head, rest])], np.concatenate([scores, self.traverse(query, everything, rest)]), k)
        essential = int(np.argmax(ahead < threshold)) if (ahead < threshold).any() else len(order)
        partial = self.traverse(query, order[:essential], rest)
        at = essential
        while at < len(order) and len(rest):
            able = partial + ahead[at] >= threshold
            rest, partial = rest[able], partial[able]
            step = order[at : at + 4]  # a few terms at a time
            partial = partial + self.traverse(query, step, rest)
            at += len(step)
            if at >= len(order) and len(rest):
                break
            floor = partial + np.minimum(query * self.most, query * self.least)[order[at:]].sum()  # reached in any case
            if len(floor) >= k:
                threshold = max(threshold, np.partition(floor, len(floor) - k)[len(floor) - k])
        return _best(self.ids[np.concatenate([head, rest])], np.concatenate([scores, partial]), k)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score and then identifier, each identifier once."""
    order = np.lexsort((ids, -scores))
    if len(np.unique(ids)) < len(ids):
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    order = order[:k]
    return ids[order], scores[order]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's rows, some SHARD_ROWS at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(at, SHARD_ROWS)
            if held and sum(x.num_rows for x in held) + part.num_rows > SHARD_ROWS:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _search(ids: np.ndarray, queries: np.ndarray, k: int):
    """A task's candidates -> the k best of all of them for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(ids)
        for rows in _shards(batches):
            terms = rows.column("terms").combine_chunks()
            wide = max(queries.shape[1], int(np.diff(terms.offsets.to_numpy()).max(initial=0)))
            shard = Shard(rows.column("vec_id").to_numpy(), _matrix(terms, wide))
            asked = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
            for i, query_id in enumerate(ids.tolist()):
                had, scored = best[i]
                more, scores = shard.top(query_id, asked[i], k, int(scored[k - 1]) if len(scored) == k else None)
                best[i] = _best(np.concatenate([had, more]), np.concatenate([scored, scores]), k)
        counts = [len(x) for x, _ in best]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([x for x, _ in best])), pa.array(np.concatenate([s for _, s in best]))], schema=_FOUND_ARROW)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` of each query's k best candidates.

    Both tables have ``vec_id`` (long) and ``terms`` (array of long), as from
    ``quantised``, which leaves out nulls; other columns are left aside, whatever
    their names.  Candidates are all vectors except those with the query's own
    identifier; fewer than k of them are all returned; ties go to the smaller
    identifier.  Vectors of unequal length, empty and very long ones too, count as
    ending in zeros.  Scores beyond the range of a long stop at its end.  An
    identifier that repeats is one candidate, or one query, with the best score of
    its vectors.  An empty table on either side gives no rows.

    ``vectors`` is evaluated once for each chunk of queries.
    """
    spark = queries.sparkSession
    vectors, queries = vectors.select("vec_id", "terms"), durable(queries.select("vec_id", "terms").distinct())
    chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
    numbered = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "terms"), F.lit(chunks)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found: list[DataFrame] = []
    for i in range(chunks):
        chunk = numbered.where(F.col("chunk") == i).select("vec_id", "terms").toArrow()  # some CHUNK_QUERIES rows
        if not chunk.num_rows:
            continue
        terms = chunk.column("terms").combine_chunks()
        asked = _matrix(terms, int(np.diff(terms.offsets.to_numpy()).max(initial=0)))
        told = vectors.mapInArrow(_search(chunk.column("vec_id").to_numpy(), asked, k), _FOUND)
        found.append(told if chunks == 1 else durable(told.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")))
    release(queries)
    every = found[0] if found else spark.createDataFrame([], _FOUND)
    for more in found[1:]:
        every = every.unionByName(more)
    once = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (SELECT r, vec_id, unnest(t) AS w, unnest(range(len(t))) AS d FROM v
), p AS (
  SELECT q.r AS q, c.r AS c, q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL
), s AS (SELECT query_id, vec_id, max(score) AS score FROM p GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
