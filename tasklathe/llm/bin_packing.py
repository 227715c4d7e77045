"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Method.  Rows with equal group keys stay together.  Groups enter bins of a fixed
capacity from the largest to the smallest, each into the bin with the least
remaining capacity that still holds it, found in a balanced tree (an AA tree
ordered by remaining capacity and bin).

Groups of one size are packed as a run: the tightest bin that holds one of them
stays the tightest as it fills, so it takes as many as go in, and then the next
bin does.  That gives what packing them one by one gives, and the driver only
sees each distinct size with its number of groups.  D distinct sizes add up to
D squared over two at least, so they are no more than the square root of twice
the total size.  Which of a run's groups go to which of its bins follows their
rank in a hash order, numbered in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sparkio import durable, release

#: Distinct sizes whose bins may be broadcast; more of them are joined as they come.
BROADCAST_SIZES = 100_000


class AATree:
    """A balanced search tree of distinct, ordered keys (Andersson's AA tree)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [level, key, left, right]

    @staticmethod
    def _skew(t: list) -> list:
        left = t[2]
        if left and left[0] == t[0]:
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t: list) -> list:
        right = t[3]
        if right and right[3] and right[3][0] == t[0]:
            t[3], right[2] = right[2], t
            right[0] += 1
            return right
        return t

    def add(self, key: tuple) -> None:
        def put(t: list | None) -> list:
            if t is None:
                return [1, key, None, None]
            side = 2 if key < t[1] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key: tuple) -> None:
        def cut(t: list | None, key: tuple) -> list | None:
            if t is None:
                return None
            if key < t[1]:
                t[2] = cut(t[2], key)
            elif key > t[1]:
                t[3] = cut(t[3], key)
            elif t[2] is None and t[3] is None:
                return None
            else:
                side, far = (3, 2) if t[2] is None else (2, 3)
                near = t[side]
                while near[far]:
                    near = near[far]
                t[1] = near[1]
                t[side] = cut(t[side], near[1])
            least = min(t[2][0] if t[2] else 0, t[3][0] if t[3] else 0) + 1
            if least < t[0]:
                t[0] = least
                if t[3] and least < t[3][0]:
                    t[3][0] = least
            t = self._skew(t)
            if t[3]:
                t[3] = self._skew(t[3])
                if t[3][3]:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3]:
                t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)

    def at_least(self, key: tuple) -> tuple | None:
        """The smallest key that isn't below ``key``."""
        t, found = self.root, None
        while t:
            if t[1] < key:
                t = t[3]
            else:
                found, t = t[1], t[2]
        return found


def best_fit_runs(runs: Iterable[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, list[tuple[int, int]]]] | None:
    """Each run (size, number of items) with its (bin, number of items), in order; None if ``most_bins`` don't suffice.

    Sizes are positive and distinct.  An item above the capacity opens a bin of its
    own.  Ties go to the lower bin, so reruns agree.
    """
    tree, bins, placed = AATree(), 0, []
    for size, count in sorted(runs, reverse=True):
        parts: list[tuple[int, int]] = []
        while count:
            fit = tree.at_least((size, -1)) if size <= capacity else None
            if fit is None:
                if bins == most_bins:
                    return None
                left, at, bins = capacity, bins, bins + 1
            else:
                tree.remove(fit)
                left, at = fit
            taken = max(1, min(count, left // size))
            count -= taken
            left -= taken * size
            parts.append((at, taken))
            if left >= 0:
                tree.add((left, at))
        placed.append((size, parts))
    return placed


def best_fit_decreasing(items: Iterable[tuple[int, object]], capacity: int, most_bins: int | None = None) -> dict | None:
    """Bin of each item (size, name); None if ``most_bins`` don't suffice.

    An item above the capacity opens a bin of its own.  Ties go to the smaller
    name, then to the lower bin, so reruns agree.
    """
    names: dict[int, list] = {}
    for size, name in sorted(items):
        names.setdefault(size, []).append(name)
    placed = best_fit_runs([(size, len(own)) for size, own in names.items()], capacity, most_bins)
    if placed is None:
        return None
    return {name: at for size, parts in placed for name, at in zip(names[size], (at for at, n in parts for _ in range(n)), strict=True)}


def pack_into(runs: Iterable[tuple[int, int]], bins: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Each run (size, number of items) with its (bin, number of items), at about the least capacity at which ``bins`` bins hold them all.

    Items above the share that is left for each bin get a bin of their own first.
    Capacities are tried upwards in doubling steps and then by bisection, down to
    a hundred-thousandth of the capacity.
    """
    rest, own = sorted(runs, reverse=True), []
    left = sum(s * n for s, n in rest)
    while rest and len(own) < bins - 1 and rest[0][0] * (bins - len(own)) > left:  # above what is left for each bin: alone
        size, count = rest[0]
        own.append(size)
        left -= size
        rest[:1] = [(size, count - 1)] if count > 1 else []
    held, largest = bins - len(own), rest[0][0] if rest else 0
    low = max(largest, -(-left // held))
    fine = max(1, low // 100_000)
    failed, step, high = low - 1, fine, low
    while (best := best_fit_runs(rest, high, held)) is None:
        failed, high, step = high, high + step, 2 * step
    while high - failed > fine:
        middle = (failed + high) // 2
        tried = best_fit_runs(rest, middle, held)
        if tried is None:
            failed = middle
        else:
            best, high = tried, middle
    placed: dict[int, list[tuple[int, int]]] = {}
    for at, size in enumerate(own):
        placed.setdefault(size, []).append((at, 1))
    for size, parts in best:
        placed.setdefault(size, []).extend((at + len(own), n) for at, n in parts)
    return sorted(placed.items(), reverse=True)


def _numbered(rows: DataFrame, key: str, spread: Column, blocks: Column, *order: str) -> DataFrame:
    """``rows`` with ``__pack_rank``, from 0 without gaps within each key.

    Rows are numbered in blocks by hash (``spread``), and blocks' counts are
    prefix-summed.  With the square root of a key's rows as their number, neither
    step has more than about that many rows in one group.
    """
    rows = rows.withColumn("__pack_block", F.pmod(spread, F.greatest(F.lit(1), F.ceil(F.sqrt(blocks.cast("double")))).cast("long")))
    counts = rows.groupBy(F.col(key).alias("__pack_k"), F.col("__pack_block").alias("__pack_b")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__pack_k").orderBy("__pack_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pack_k", "__pack_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__pack_before"))
    inside = Window.partitionBy(key, "__pack_block").orderBy(*order)
    placed = rows.withColumn("__pack_place", F.row_number().over(inside) - 1)
    joined = placed.join(offsets, (F.col(key) == F.col("__pack_k")) & (F.col("__pack_block") == F.col("__pack_b")))
    return joined.withColumn("__pack_rank", (F.col("__pack_before") + F.col("__pack_place")).cast("long"))


def assign(docs: DataFrame, size: Column, group: Column, bins: int) -> DataFrame:
    """``docs`` with ``shard`` (0 to bins - 1) and ``slot`` (gapless from 0 in its shard).

    docs has a ``doc_id`` (long); give it the columns that the result needs, as
    it is written once to the shared folder (very long texts best as digests).
    Rows of one group share a shard; ``group`` must be a non-null binary (a digest
    of what makes rows equal).  Sizes are positive; shards' sizes come as near to
    equal as the largest group allows.  Slots follow a hash of group and
    ``doc_id``; rows equal in both get neighbouring slots, those with null ids in
    no fixed order among themselves.  Columns named ``shard`` or ``slot``, and
    those whose names begin with ``__pack``, are replaced or dropped.  An empty
    table gives an empty result.  A group above a shard's fair share stays whole:
    then its shard is that much larger.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot") and not c.startswith("__pack")]
    unnamed = -1 - F.monotonically_increasing_id()  # tells rows without an id apart
    keyed = durable(docs.select(*kept, group.alias("__pack_group"), size.cast("long").alias("__pack_size"), F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("__pack_id")))
    groups = durable(keyed.groupBy("__pack_group").agg(F.sum("__pack_size").alias("__pack_bytes"), F.count(F.lit(1)).alias("__pack_rows")))
    rows = groups.agg(F.coalesce(F.sum("__pack_rows"), F.lit(0))).first()[0]
    sizes = groups.groupBy("__pack_bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()  # distinct sizes, see above
    runs = list(zip(sizes.column(0).to_pylist(), sizes.column(1).to_pylist(), strict=True))
    placed = pack_into(runs, bins)
    ends = [[0, *(sum(n for _, n in parts[: i + 1]) for i in range(len(parts)))] for _, parts in placed]
    plan = pa.table({
        "__pack_of": pa.array([s for s, _ in placed], type=pa.int64()),
        "__pack_n": pa.array([e[-1] for e in ends], type=pa.int64()),
        "__pack_starts": pa.array([e[:-1] for e in ends], type=pa.list_(pa.int64())),
        "__pack_bins": pa.array([[at for at, _ in parts] for _, parts in placed], type=pa.list_(pa.int32())),
    })
    by_size = spark.createDataFrame(plan)
    told = groups.join(F.broadcast(by_size) if len(placed) <= BROADCAST_SIZES else by_size, F.col("__pack_bytes") == F.col("__pack_of"))
    one = told.where(F.size("__pack_bins") == 1).select("__pack_group", F.element_at("__pack_bins", 1).alias("shard"))
    several = _numbered(told.where(F.size("__pack_bins") > 1), "__pack_bytes", F.xxhash64("__pack_group"), F.col("__pack_n"), "__pack_group")
    part = F.size(F.filter("__pack_starts", lambda x: x <= F.col("__pack_rank")))
    several = several.select("__pack_group", F.element_at("__pack_bins", part).alias("shard"))
    # As a key of its own, so that a group of very many copies can be split in the join.
    shards = one.unionByName(several).select(F.concat("__pack_group", F.lit(b"")).alias("__pack_group"), "shard")
    found = durable(keyed.join(shards, "__pack_group"))
    release(keyed, groups)
    return _numbered(found, "shard", F.xxhash64("__pack_group", "__pack_id"), F.lit(rows), "__pack_group", "__pack_id").select(*kept, "shard", F.col("__pack_rank").alias("slot"))
