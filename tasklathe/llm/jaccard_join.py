"""N-gram Jaccard join: a size-aware heavy-light similarity join over word shingles.

Method.  Every text becomes the set of its distinct k-word shingles.  Two sets
of sizes n and m have a Jaccard similarity of at least num/den exactly if they
share ``need(n, m) = ceil(num * (n + m) / (num + den))`` shingles, and a set
can only have partners with which it shares at least ``ceil(num * n / den)``.

1. Sets with equal content are one *class* (exact copies cost nothing later).
2. Packed shingle blocks meet in hash ranges (see ``scatter``).  A shingle that
   only one class has can't be shared and goes no further; what is left goes
   back to its class with the number of classes that have it.
3. A class with too few shared shingles has no partner.  The others order theirs
   from rare to common.  For a class of size n only the first
   ``n2 - ceil(num * n / den) + 1`` of its n2 shared shingles need posting: two
   partners always have one of those in common.
4. Small sets enumerate their subsets of exactly ``need(n, m)`` shingles for each
   possible partner size m.  Sets of those sizes that meet in a subset are
   linked, with no further test.
5. Large sets are found through inverted lists of posted shingles; small sets
   near the boundary are posted as well, for pairs across it.
6. The boundary is where enumerated subsets and scanned list entries together
   are fewest, from a histogram of the sets up to 32 shingles.

Links within a list are not expanded into all pairs.  Every member of a list is
compared with the list's centre: linked if near enough, and in any case its
difference from the centre's shared shingles and that difference's size d are
known.  For two members |x - y| = d(x) + d(y) - 2 * |diff(x) & diff(y)|, with
x - y the symmetric difference.  Where d(x) + d(y) alone is small enough the pair
is linked; all such pairs are, once each member is tested so with the nearest
one.  Any other pair needs differences in common, so what is left is an inverted
list over differences, rare first and by the same prefix and position rules,
between members of different components.  Where such lists are long, their members
are compared with one of them, which then leaves the list, and components are
joined, as long as that pays; only what is left is compared pair by pair.
Copies and near copies cost their number, and no link between different
components is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scatter, wordbuf
from .components import components
from .sparkio import dealt_anew, durable, release, width
from .wordbuf import U64

WORDS = 5
NUM, DEN = 4, 5
#: Sets of at most so many shingles can be enumerated.
SMALL_MOST = 32
#: Bytes of text handled at a time in a map task.
_SLICE = 1 << 23
#: A shingle that so many classes of a slice have goes to its range as a count.
FREQUENT_LEAST = 16
#: Pairs that the lists of differences may come to for each of their entries before a further centre is compared first.
PAIRS_AN_ENTRY = 8


def least_shared(n: int) -> int:
    """Shingles that a set of size n shares with any partner, at least."""
    return -(-NUM * n // DEN)


def need(n: int, m: int) -> int:
    """Shingles that sets of sizes n and m must share."""
    return -(-NUM * (n + m) // (NUM + DEN))


def partner_sizes(n: int) -> range:
    return range(least_shared(n), n * DEN // NUM + 1)


def subset_count(n: int, shared: int) -> int:
    """Subsets that a set of size n with so many shared shingles enumerates."""
    return sum(comb(shared, need(n, m)) for m in partner_sizes(n))


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set's content; 0 for an empty set only."""
    size = np.array([len(s) for s in sets], dtype=U64)
    total = np.array([np.add.reduce(s) for s in sets], dtype=U64)
    parity = np.array([np.bitwise_xor.reduce(s) for s in sets], dtype=U64)
    mixed = wordbuf.mix(total + parity * U64(0x9E3779B97F4A7C15) + size)
    mixed[mixed == 0] = 1
    mixed[size == 0] = 0
    return mixed


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges with their shingle sets."""
    sets: list[np.ndarray] = []
    first, held = 0, 0
    for a, b, data, offsets in wordbuf.pieces(texts):
        if sets and held + len(data) > _SLICE:
            yield first, a, sets
            sets, first, held = [], a, 0
        sets += wordbuf.shingle_sets(data, offsets, WORDS)
        held += len(data)
    if sets:
        yield first, len(texts), sets


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wordbuf.kept("jaccard_join")
    for batch in batches:
        for a, b, sets in _slices(batch.column("text")):
            kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            sizes = pa.array(np.array([len(s) for s in sets], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*kept, sizes, pa.array(_fingerprints(sets).view(np.int64))], names=[*names, "n_shingles", "set_key"])
    wordbuf.give_back()


def shingle_keys(docs: DataFrame) -> DataFrame:
    """``docs`` (a column ``text``, and any others) with the text replaced by ``n_shingles`` and ``set_key``."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(_identify, f"{kept}{', ' if kept else ''}n_shingles long, set_key long")


_BLOCK = "kind int, part int, home int, keys binary, counts binary, items binary, spread binary"
_BLOCK_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("home", pa.int32()), *[(x, pa.binary()) for x in ("keys", "counts", "items", "spread")]])
#: Kinds of blocks: postings, how many of a slice's classes have its frequent shingles, postings of those, and classes' sizes.
POSTED, FREQUENT, WAITING, SIZES = range(4)


def _block(kind: int, part: int, items: bytes, keys: bytes = b"", counts: bytes = b"", spread: bytes = b"", home: int = 0) -> dict:
    return {"kind": kind, "part": part, "home": home, "keys": keys, "counts": counts, "items": items, "spread": spread}


def _frequent(items: np.ndarray) -> np.ndarray:
    """Which items occur FREQUENT_LEAST times or more; each class has an item once."""
    slot = (items & U64((1 << 20) - 1)).astype(np.int64)
    maybe = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= FREQUENT_LEAST)[slot])
    out = np.zeros(len(items), dtype=bool)
    if len(maybe):
        _, which, times = np.unique(items[maybe], return_inverse=True, return_counts=True)
        out[maybe] = times[which] >= FREQUENT_LEAST
    return out


def _scatter_sets(ranges: int):
    """Blocks of shingles by hash range; equal sets of a slice count once.

    A shingle that many of a slice's classes have goes to its range as one count.
    Its postings wait in a bucket that the slice chooses, so however many classes
    of the corpus have a shingle, no task meets all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordbuf.kept("jaccard_join")
        for batch in batches:
            for _, _, sets in _slices(batch.column("text")):
                keys, first = np.unique(_fingerprints(sets), return_index=True)
                first = first[keys != 0]
                if not len(first):
                    continue
                keys = keys[keys != 0]
                chosen = [sets[i] for i in first]
                items = np.concatenate(chosen)
                owners = np.repeat(np.arange(len(chosen), dtype=np.int32), [len(s) for s in chosen])
                sets.clear()  # their shingles are in ``items`` now
                del chosen
                often = _frequent(items)
                rows = []
                if often.any():
                    home = int(keys[0] % U64(ranges))
                    known = _known(items[often], ranges)
                    who, counts = scatter.owner_runs(owners[often])
                    rows.append(_block(WAITING, home, known.tobytes(), keys[who].tobytes(), counts.astype(np.uint32).tobytes()))
                    known, times = np.unique(known, return_counts=True)
                    at = np.searchsorted(known >> U64(48), np.arange(ranges + 1, dtype=U64))
                    for part in np.flatnonzero(np.diff(at)).tolist():
                        lo, hi = at[part], at[part + 1]
                        rows.append(_block(FREQUENT, part, scatter.pack48(scatter.low_bits(known[lo:hi])), spread=times[lo:hi].astype(np.uint32).tobytes(), home=home))
                    items, owners = items[~often], owners[~often]
                order, at = scatter.by_part(scatter.range_of(items, ranges), ranges)
                items, owners = scatter.low_bits(items[order]), owners[order]
                for part in np.flatnonzero(np.diff(at)).tolist():
                    lo, hi = at[part], at[part + 1]
                    who, counts = scatter.owner_runs(owners[lo:hi])
                    rows.append(_block(POSTED, part, scatter.pack48(items[lo:hi]), keys[who].tobytes(), counts.astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK_ARROW)
        wordbuf.give_back()

    return run


def _known(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Items as they are known outside their range: the range's number and the low 48 bits."""
    return (scatter.range_of(hashes, ranges) << U64(48)) | scatter.low_bits(hashes)


def _runs(keys: list[bytes], counts: list[bytes]) -> np.ndarray:
    """The owner of each item."""
    return np.concatenate([np.repeat(np.frombuffer(k, dtype=U64), np.frombuffer(c, dtype=np.uint32)) for k, c in zip(keys, counts, strict=True)] or [np.zeros(0, dtype=U64)])


def _joined(raw: list[bytes], kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in raw] or [np.zeros(0, dtype=kind)])


def _by_class(key: np.ndarray, item: np.ndarray, spread: np.ndarray, ranges: int) -> list[dict]:
    """Postings as blocks by the bucket of their class."""
    order = np.argsort(key, kind="stable")
    key, item, spread = key[order], item[order], spread[order]
    bucket = scatter.range_of(key, ranges)  # grows with the key
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, dtype=np.int64)
    rows = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        who, counts = scatter.owner_runs(key[lo:hi])
        rows.append(_block(POSTED, int(bucket[lo]), item[lo:hi].tobytes(), who.tobytes(), counts.astype(np.uint32).tobytes(), spread[lo:hi].astype(np.uint32).tobytes()))
    return rows


def _share(ranges: int):
    """All blocks of a hash range -> its shingles that several classes have, by bucket of the class; counts of frequent ones, by the slices' buckets."""

    def run(table: pa.Table) -> pa.Table:
        wordbuf.kept("jaccard_join")
        part = U64(table.column("part")[0].as_py())
        by_kind: dict[int, list[dict]] = {k: [] for k in range(4)}
        for r in table.to_pylist():
            by_kind[r["kind"]].append(r)
        key = _runs([r["keys"] for r in by_kind[POSTED]], [r["counts"] for r in by_kind[POSTED]])
        item = np.concatenate([scatter.unpack48(r["items"]) for r in by_kind[POSTED]] or [np.zeros(0, dtype=U64)])
        order = np.lexsort((key, item))
        key, item = key[order], item[order]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (key[1:] != key[:-1])
        key, item = key[new], item[new]
        kinds, runs = scatter.owner_runs(item)
        spread = runs.astype(np.int64)
        told = [(r["home"], scatter.unpack48(r["items"]), np.frombuffer(r["spread"], dtype=np.uint32)) for r in by_kind[FREQUENT]]
        rows = by_kind[WAITING]
        if told:
            often, which = np.unique(np.concatenate([x for _, x, _ in told]), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate([n for _, _, n in told])).astype(np.int64)
            if len(kinds):
                place = np.minimum(np.searchsorted(kinds, often), len(kinds) - 1)
                here = kinds[place] == often
                times[here] += spread[place[here]]
                spread[place[here]] = times[here]
            for home in {h for h, _, _ in told}:
                asked = np.unique(np.concatenate([x for h, x, _ in told if h == home]))
                total = np.minimum(times[np.searchsorted(often, asked)], (1 << 32) - 1).astype(np.uint32)
                rows.append(_block(FREQUENT, home, (asked | (part << U64(48))).tobytes(), spread=total.tobytes()))
        spread = np.repeat(np.minimum(spread, (1 << 32) - 1), runs)
        several = spread > 1
        rows += _by_class(key[several], item[several] | (part << U64(48)), spread[several], ranges)
        return pa.Table.from_pylist(rows, schema=_BLOCK_ARROW)

    return run


def _attach(ranges: int):
    """A bucket's waiting postings and the counts of their shingles -> postings by bucket of the class."""

    def run(table: pa.Table) -> pa.Table:
        wordbuf.kept("jaccard_join")
        told = [r for r in table.to_pylist() if r["kind"] == FREQUENT]
        item, first = np.unique(_joined([r["items"] for r in told], U64), return_index=True)
        spread = _joined([r["spread"] for r in told], np.uint32)[first]
        waiting = [r for r in table.to_pylist() if r["kind"] == WAITING]
        posted = _joined([r["items"] for r in waiting], U64)
        rows = _by_class(_runs([r["keys"] for r in waiting], [r["counts"] for r in waiting]), posted, spread[np.searchsorted(item, posted)], ranges)
        return pa.Table.from_pylist(rows, schema=_BLOCK_ARROW)

    return run


def _class_sizes(ranges: int):
    """Classes' sizes as blocks by their bucket; copies of a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordbuf.kept("jaccard_join")
        for batch in batches:
            key, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(U64), return_index=True)
            size = batch.column(1).to_numpy(zero_copy_only=False)[first].astype(np.uint32)
            bucket = scatter.range_of(key, ranges)
            at = np.searchsorted(bucket, np.arange(ranges + 1, dtype=U64))
            rows = [_block(SIZES, p, b"", key[at[p] : at[p + 1]].tobytes(), size[at[p] : at[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(at)).tolist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK_ARROW)

    return run


_CLASS = "key long, n int, shared int, posted int, scan long, items array<long>"
_CLASS_ARROW = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("posted", pa.int32()), ("scan", pa.int64()), ("items", pa.list_(pa.int64()))])


def _gather(table: pa.Table) -> pa.Table:
    """All blocks of a bucket of classes -> the classes that can have a partner, shingles from rare to common."""
    wordbuf.kept("jaccard_join")
    kind = table.column("kind").to_numpy()
    rows = table.to_pylist()
    posts, heads = ([r for r, k in zip(rows, kind, strict=True) if k == wanted] for wanted in (POSTED, SIZES))
    key, item, spread = _runs([r["keys"] for r in posts], [r["counts"] for r in posts]), _joined([r["items"] for r in posts], U64), _joined([r["spread"] for r in posts], np.uint32)
    order = np.lexsort((item, spread, key))
    key, item, spread = key[order], item[order], spread[order].astype(np.int64)
    new = np.ones(len(item), dtype=bool)  # a class of two slices may bring a shingle twice
    new[1:] = (item[1:] != item[:-1]) | (key[1:] != key[:-1])
    key, item, spread = key[new], item[new], spread[new]
    owner, shared = scatter.owner_runs(key)
    starts = np.cumsum(shared) - shared
    known, first = np.unique(_joined([r["keys"] for r in heads], U64), return_index=True)
    n = _joined([r["counts"] for r in heads], np.uint32)[first].astype(np.int64)[np.searchsorted(known, owner)]
    posted = shared - (NUM * n + DEN - 1) // DEN + 1
    total = np.concatenate([[0], np.cumsum(spread)])
    able = np.flatnonzero(posted > 0)
    owner, starts, shared, n, posted = owner[able], starts[able], shared[able], n[able], posted[able]
    offsets = np.concatenate([[0], np.cumsum(shared)])
    inside = np.repeat(starts - offsets[:-1], shared) + np.arange(offsets[-1])
    items = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(item[inside].view(np.int64)))
    arrays = [pa.array(owner.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(shared.astype(np.int32)), pa.array(posted.astype(np.int32)), pa.array(total[starts + posted] - total[starts]), items]
    return pa.Table.from_arrays(arrays, schema=_CLASS_ARROW)


def boundary(histogram: list[tuple[int, int, int, int]]) -> int:
    """The largest size that enumerates.  histogram: (size, shared, sets, entries scanned by them), sizes up to SMALL_MOST."""
    enumerate_cost = [0] * (SMALL_MOST + 2)
    scan_cost = [0] * (SMALL_MOST + 2)
    for n, shared, sets, scan in histogram:
        enumerate_cost[n] += sets * subset_count(n, shared)
        scan_cost[n] += scan
    best, at = None, 0
    for b in range(SMALL_MOST + 1):
        cost = sum(enumerate_cost[: b + 1]) + sum(scan_cost[least_shared(b + 1) :])
        if best is None or cost < best:
            best, at = cost, b
    return at


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small classes -> one row for each of their subsets of the sizes that a partner calls for."""
    wordbuf.kept("jaccard_join")
    chosen: dict[tuple[int, int], np.ndarray] = {}
    schema = pa.schema([("subset", pa.int64()), ("key", pa.int64()), ("smaller", pa.bool_())])
    for batch in batches:
        for key, n, items in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "items")), strict=True):
            values = np.sort(np.array(items, dtype=np.int64).view(U64))
            for m in partner_sizes(n):
                k = need(n, m)
                if k > len(values):
                    continue
                if (len(values), k) not in chosen:
                    chosen[len(values), k] = np.array(list(itertools.combinations(range(len(values)), k)), dtype=np.int64)
                hashed = np.full(len(chosen[len(values), k]), U64(min(n, m) * 1000 + max(n, m)))
                for column in values[chosen[len(values), k]].T:
                    hashed = wordbuf.mix(hashed + column)
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(np.full(len(hashed), key, dtype=np.int64)), pa.array(np.full(len(hashed), n <= m))], schema=schema)


def _small_links(small: DataFrame) -> DataFrame:
    """Links between small classes: those in a subset's group with one of the smaller size all are linked with it."""
    met = small.select("key", "n", "items").mapInArrow(_enumerate, "subset long, key long, smaller boolean")
    centre = met.groupBy("subset").agg(F.min(F.when(F.col("smaller"), F.col("key"))).alias("centre"), F.count(F.lit(1)).alias("met")).where("met > 1 AND centre IS NOT NULL").select("subset", "centre")
    return met.join(centre, "subset").where("key <> centre").select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct()


def _shared(pairs: DataFrame, classes: DataFrame, *more: Column) -> DataFrame:
    """Pairs (x, y) with ``xn``, ``yn`` and the number of shingles they share, ``both``; ``more`` may use their shingles, ``xi`` and ``yi``."""
    x = classes.select(F.col("key").alias("x"), F.col("n").alias("xn"), F.col("items").alias("xi"))
    y = classes.select(F.col("key").alias("y"), F.col("n").alias("yn"), F.col("items").alias("yi"))
    return pairs.join(x, "x").join(y, "y").select(*pairs.columns, "xn", "yn", F.size(F.array_intersect("xi", "yi")).alias("both"), F.size("yi").alias("yshared"), *more)


#: A pair is linked: num/den of its union is shared.
_ENOUGH = f"{NUM + DEN} * both >= {NUM} * (xn + yn)"


def _differences(apart: DataFrame, classes: DataFrame) -> DataFrame:
    """``x``, ``c`` (its centre), ``n``, ``root``, ``d``, ``size``, ``place``, ``item``: the posted differences of classes from their centres, rare ones first."""
    diff = F.concat(F.array_except("xi", "yi"), F.array_except("yi", "xi")).alias("diff")
    told = _shared(apart.withColumnRenamed("c", "y"), classes, diff)
    single = told.select("x", dealt_anew("y").alias("c"), F.explode("diff").alias("item"))
    often = single.groupBy("c", "item").agg(F.count(F.lit(1)).alias("often")).where("often > 1").select(dealt_anew("c"), "item", "often")
    ranked = single.join(often, ["c", "item"]).groupBy("x", "c").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("diff"))
    in_common = F.greatest(F.lit(1), F.ceil(F.col("d") - F.col("n") * (DEN / NUM - 1)))
    sized = apart.join(ranked, ["x", "c"]).withColumn("size", F.size("diff"))
    posted = sized.select("x", "c", "n", "root", "d", "size", F.posexplode(F.slice("diff", F.lit(1), F.greatest(F.lit(0), (F.col("size") - in_common + 1).cast("int")))).alias("place", "item"))
    return posted.withColumn("item", F.col("item.item"))


def _lists(posted: DataFrame, turn: int) -> DataFrame:
    """Lists of differences that hold several components, with their length ``met`` and a member as centre, ``y`` of component ``yroot``."""
    chosen = F.min_by(F.struct("x", "root"), F.xxhash64("x", F.lit(turn)))
    lists = posted.groupBy("c", "item").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("met"), chosen.alias("y"))
    return lists.where("lo <> hi").select(dealt_anew("c"), "item", "met", F.col("y.x").alias("y"), F.col("y.root").alias("yroot"))


def _joined_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Components of links (a, b) and of those already known."""
    found = components(links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    release(links, roots)
    return found


def links(classes: DataFrame) -> DataFrame:
    """``node``, ``root``: the components of the links between classes (columns of ``_gather``); roots themselves are left out."""
    sizes = classes.where(F.col("n") <= SMALL_MOST).groupBy("n", "shared").agg(F.count(F.lit(1)), F.sum("scan"))
    small_to = boundary([tuple(r) for r in sizes.collect()])  # SMALL_MOST squared rows at most
    found = _small_links(classes.where(F.col("n") <= small_to))
    posting = classes.where(F.col("n") >= least_shared(small_to + 1)).select("key", (F.col("n") > small_to).alias("large"), F.explode(F.slice("items", 1, F.col("posted"))).alias("item"))
    centre = posting.groupBy("item").agg(F.min_by("key", F.xxhash64("key")).alias("c"), F.count(F.lit(1)).alias("met"), F.max("large").alias("large")).where("met > 1 AND large").select(dealt_anew("item"), "c", "met")
    seen = posting.join(centre, "item").where("key <> c").select(dealt_anew("key").alias("x"), F.col("c").alias("y"), "met").groupBy("x", "y").agg(F.max("met").alias("met"))
    d = (F.col("xn") + F.col("yshared") - 2 * F.col("both")).alias("d")
    compared = durable(_shared(seen, classes).select("x", "y", "met", "xn", "yn", "both", d).withColumn("f", (NUM + DEN) * F.col("d") - (DEN - NUM) * F.col("xn")))
    nearest = compared.groupBy("y").agg(F.min_by(F.struct("x", "f"), "f").alias("z")).select(dealt_anew("y"), "z")
    both_near = compared.join(nearest, "y").where(F.col("f") + F.col("z.f") <= 0).where(F.col("x") != F.col("z.x")).select(F.col("x").alias("a"), F.col("z.x").alias("b"))
    roots = components(found.union(compared.where(_ENOUGH).select(F.col("x").alias("a"), F.col("y").alias("b"))).union(both_near))

    # What the centres didn't link: partners share a difference from the centre.
    apart = compared.where("met > 2").join(roots.select(F.col("node").alias("x"), F.col("root").alias("xr")), "x", "left").select("x", dealt_anew("y").alias("c"), F.col("xn").alias("n"), F.coalesce("xr", "x").alias("root"), "d")
    mixed = apart.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(dealt_anew("c"))
    apart = durable(apart.join(mixed, "c").select("x", dealt_anew("c"), "n", "root", "d"))
    release(compared)
    posted = durable(_differences(apart, classes))
    release(apart)
    turn, before = 0, None
    while True:
        lists = durable(_lists(posted, turn))
        entries, pairs = lists.agg(F.coalesce(F.sum("met"), F.lit(0)), F.coalesce(F.sum(F.col("met").cast("double") * (F.col("met") - 1) / 2), F.lit(0.0))).first()
        if not entries:
            release(posted, lists)
            return roots
        if pairs <= PAIRS_AN_ENTRY * entries or (before is not None and 2 * pairs > before):
            break
        # Long lists: their members are compared with one of them, which then leaves.
        turn, before = turn + 1, pairs
        held = posted.join(lists, ["c", "item"])
        seen = held.where("root <> yroot").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        more = durable(_shared(seen, classes).where(_ENOUGH).select(F.col("x").alias("a"), F.col("y").alias("b")))
        roots = _joined_roots(more, roots)
        moved = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
        left = held.where("x <> y").drop("met", "y", "yroot").join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        left = durable(left.select(*posted.columns))
        release(posted, lists)
        posted = left
    ahead = F.least(F.col("p.size") - F.col("p.place"), F.col("q.size") - F.col("q.place"))
    able = 2 * (NUM + DEN) * ahead >= (NUM + DEN) * (F.col("p.d") + F.col("q.d")) - (DEN - NUM) * (F.col("p.n") + F.col("q.n"))
    held = posted.join(lists.select("c", "item"), ["c", "item"])
    met = held.alias("p").join(held.alias("q"), (F.col("p.c") == F.col("q.c")) & (F.col("p.item") == F.col("q.item")) & (F.col("p.root") < F.col("q.root")) & able)
    pairs = met.select(F.greatest("p.x", "q.x").alias("x"), F.least("p.x", "q.x").alias("y")).distinct()
    more = durable(_shared(pairs, classes).where(_ENOUGH).select(F.col("x").alias("a"), F.col("y").alias("b")))
    release(posted, lists)
    return _joined_roots(more, roots)


#: Columns that ``jaccard_classes`` adds.
ADDED = ("n_shingles", "set_key", "class_key", "component_id")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Near-duplicate groups of whole texts: every row's id, ``n_shingles``, ``set_key``, ``class_key`` and ``component_id``.

    docs has ``id_col`` (long) and ``text``; other columns are carried along, but
    for those with an added column's name, which are replaced.  Sets are of
    distinct 5-word shingles with A-Z folded, and texts link at a Jaccard
    similarity of 0.8 or more.  component_id is the smallest id reachable by
    links; class_key names the component where ids are null, and is null for
    texts without shingles.

    Null, empty and blank texts have no shingles, link with nothing and are
    their own component.  Texts of fewer than five words have one shingle.  Very
    long texts are taken whole; one text's shingles have to fit a task.  Rows
    with equal text always share a component, repeated ids included; a null id
    takes the smallest other id of its component, or null.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    ids = durable(shingle_keys(docs))
    total = ids.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = scatter.ranges_for(total, width(spark))
    blocks = docs.select("text").mapInArrow(_scatter_sets(ranges), _BLOCK)
    shared = durable(blocks.groupBy("part").applyInArrow(_share(ranges), _BLOCK))
    attached = shared.where(F.col("kind").isin(FREQUENT, WAITING)).groupBy("part").applyInArrow(_attach(ranges), _BLOCK)
    sizes = ids.where("n_shingles > 0").select("set_key", "n_shingles").mapInArrow(_class_sizes(ranges), _BLOCK)
    classes = durable(shared.where(F.col("kind") == POSTED).union(attached).union(sizes).groupBy("part").applyInArrow(_gather, _CLASS))
    release(shared)
    roots = links(classes)
    release(classes)
    lowest = ids.where("n_shingles > 0").groupBy("set_key").agg(F.min(id_col).alias("low"))
    rooted = lowest.join(roots, F.col("set_key") == F.col("node"), "left").select("set_key", "low", F.coalesce("root", "set_key").alias("class_key"))
    named = rooted.join(rooted.groupBy("class_key").agg(F.min("low").alias("component_id")), "class_key").select(dealt_anew("set_key"), "class_key", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col))
    return ids.join(named, "set_key", "left").withColumn("component_id", own)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, and of repeats of that the text with the smallest hash.

    docs has ``doc_id`` and ``text``; other columns stay as they are.  Rows
    without shingles link with nothing and all stay, whatever their ids; null ids
    come after all others.  What stays is decided on identifiers and digests, so
    texts move once, to meet the decision.  An empty table stays empty.
    """
    mark = F.xxhash64("text")
    ids = durable(jaccard_classes(docs.select("doc_id", mark.alias("mark"), "text")).where("n_shingles > 0").select("class_key", "doc_id", "mark"))
    first = ids.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"))
    keep = first.select(F.col("first.doc_id").alias("__id"), F.col("first.mark").alias("__mark"), F.lit(True).alias("__first"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__mark")), "left").where(F.col("__first") | ~worded)
    repeats = ids.groupBy("class_key", "doc_id", "mark").count().where("count > 1")
    kept = kept.withColumn("__worded", worded).drop("__id", "__first")
    if not repeats.isEmpty():
        kept = kept.where("__worded").dropDuplicates(["doc_id", "__mark"]).union(kept.where("NOT __worded"))
    return kept.drop("__mark", "__worded")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * i >= 80 * (n + m - i) UNION ALL SELECT b, a FROM p WHERE 100 * i >= 80 * (n + m - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, reach.c FROM reach JOIN l ON reach.a = l.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, r.c AS component_id FROM s JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
