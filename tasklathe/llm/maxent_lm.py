"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

Method.  The probability of a token is that of its class given the tokens before
it, times that of the token within its class.  The class distribution is a
softmax over hashed features of the history: the last token, the last two as a
bigram, and two skips (the second and third last alone).  Within a class, the
dictionary's tokens and one leaf for each ending's rarer ones hang in a Huffman
tree; every fork is a softmax over its two sides with the same features of the
history, of the tokens themselves here, hashed together with the fork.  Weights
of nought would give add-one unigrams.  Rarer tokens follow their add-one counts
over their ending's total.  Tokens are a text's words and one end mark.

1. Tokens of the training texts are counted in hash ranges (see ``scatter``).
   Tokens above a fixed share of all tokens form the dictionary; a share can be
   reached by 1 / share tokens at most, so it can be broadcast at any size.
2. The most frequent tokens and, for all others, their endings are types.  Types
   are clustered into classes by the frequent tokens found beside them, over all
   training texts.
3. Training runs in rounds, each over its own part of the texts, so that every
   text is learnt once.  Every task takes gradient steps over its texts' tokens in
   order (AdaGrad, minibatches), from where the last round ended, and hands in its
   weights in blocks; blocks are averaged by how often a task has met each feature.
4. The scoring pass evaluates whole texts in sparse numpy batches.  Counts of
   dictionary tokens are at hand; rarer tokens travel in packed blocks to their
   hash range, meet the count table there, and go back to their text as sums.

Unseen tokens count as one more rare token of their ending.  The class part's
size is fixed; the forks follow the dictionary and their slots the number of
training tokens up to a limit; the counts are of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scatter, wordbuf
from .sparkio import collected, durable, width
from .wordbuf import U64

#: A dictionary token is this share of the training tokens at least.
DICTIONARY_SHARE = 2e-6
TOP_TYPES, ENDINGS, ANCHORS, CLASSES = 4096, 1024, 48, 32
FEATURES, BATCH, RATE = 1 << 16, 1 << 14, 0.25
#: Training tokens for each weight of the forks, and the weights at least and at most, as powers of two.
SLOT_TOKENS, SLOT_BITS = 32, (16, 20)
INNER_BATCH = 1 << 15
#: Rounds of gradient steps, each over its own part of the training texts, with weights averaged after each.
ROUNDS = 2
#: Training tokens of a task in a round, about, and tasks of a round, at least (if there are as many partitions).
TASK_TOKENS, TASKS_LEAST = 2_000_000, 16
_SLICE = 1 << 22
_BLOCKS = 16
_END = U64(0x5EED0FE4D0C5A11F)
#: Types: the top tokens, endings of the others, and what stands before a text.
TYPES = TOP_TYPES + ENDINGS + 1
_START = TYPES - 1


def held_out(doc_id: Column) -> Column:
    """Texts that aren't learnt: crc32 of the identifier's text leaves 2 after division by 7."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the rows' tokens in order, their endings' types, and each row's first token (one more at the end).

    A code is the hash range and the hash's low 48 bits.
    """
    begin, end, at = wordbuf.words(data, offsets)
    hashed = wordbuf.word_hashes(data, begin, end)
    if len(data):
        last, before = wordbuf._LOWER[data[end - 1]].astype(np.int64), wordbuf._LOWER[data[np.maximum(end - 2, begin)]].astype(np.int64)
        ending = (last * 31 + before * 7919) % ENDINGS
    else:
        ending = np.zeros(0, dtype=np.int64)
    code = (scatter.range_of(hashed, ranges) << U64(48)) | scatter.low_bits(hashed)
    end_code = (scatter.range_of(np.array([_END]), ranges) << U64(48)) | scatter.low_bits(np.array([_END]))
    return np.insert(code, at[1:], end_code[0]), np.insert(ending, at[1:], 0), at + np.arange(len(at))


def _slices(batches: Iterator[pa.RecordBatch], ranges: int):
    for batch in batches:
        for a, b, data, offsets in wordbuf.pieces(batch.column("text"), _SLICE):
            yield batch, a, b, *tokens(data, offsets, ranges)
    wordbuf.give_back()


_TABLE = "kind int, part int, items binary, counts binary, endings binary, total long, kinds long"
_TABLE_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("items", pa.binary()), ("counts", pa.binary()), ("endings", pa.binary()), ("total", pa.int64()), ("kinds", pa.int64())])


def _count(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, code, ending, _ in _slices(batches, ranges):
            code, first, counts = np.unique(code, return_index=True, return_counts=True)
            ending = ending[first].astype(np.uint16)
            at = np.searchsorted(code, np.arange(ranges + 1, dtype=np.uint64) << U64(48)) if ranges < 1 << 16 else np.append(np.searchsorted(code, np.arange(ranges, dtype=np.uint64) << U64(48)), len(code))
            rows = [
                {"kind": 0, "part": p, "items": scatter.pack48(scatter.low_bits(code[i:j])), "counts": counts[i:j].astype(np.uint32).tobytes(), "endings": ending[i:j].tobytes(), "total": 0, "kinds": 0}
                for p, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                if j > i
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_TABLE_ARROW)

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()] or [np.zeros(0, dtype=kind)])


def _sum_counts(table: pa.Table) -> pa.Table:
    """All blocks of a range -> one row: its tokens, their counts (64 bits) and endings."""
    items = np.concatenate([scatter.unpack48(x) for x in table.column("items").to_pylist()])
    counts, endings = _joined(table, "counts", np.uint32).astype(np.int64), _joined(table, "endings", np.uint16)
    order = np.argsort(items, kind="stable")
    items, counts, endings = items[order], counts[order], endings[order]
    starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
    summed = np.add.reduceat(counts, starts)
    row = {"kind": 0, "part": table.column("part")[0].as_py(), "items": scatter.pack48(items[starts]), "counts": summed.tobytes(), "endings": endings[starts].tobytes(), "total": int(summed.sum()), "kinds": len(starts)}
    return pa.Table.from_pylist([row], schema=_TABLE_ARROW)


class Lookup:
    """Places of codes in a sorted array, by a table of their low bits and a search for those that share a slot."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.mask = U64((1 << max(10, (4 * max(1, len(codes))).bit_length())) - 1)
        slot = (codes & self.mask).astype(np.int64)
        taken = np.bincount(slot, minlength=int(self.mask) + 1)
        self.place = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        self.place[slot] = np.arange(len(codes))
        self.shared = taken > 1

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for one that isn't there."""
        if not len(self.codes):
            return np.full(len(codes), -1, dtype=np.int32)
        slot = (codes & self.mask).astype(np.int64)
        out = self.place[slot]
        out = np.where(self.codes[out] == codes, out, -1)
        again = np.flatnonzero((out < 0) & self.shared[slot])
        found = np.minimum(np.searchsorted(self.codes, codes[again]), len(self.codes) - 1)
        out[again] = np.where(self.codes[found] == codes[again], found, -1)
        return out


@dataclass
class Counts:
    """The dictionary (sorted codes and counts), the places of its top tokens by type, and the corpus totals."""

    ranges: int
    codes: np.ndarray
    counts: np.ndarray
    top: np.ndarray  # type of each dictionary token, -1 beyond the top
    total: int
    kinds: int

    def __post_init__(self) -> None:
        self.find = None

    def places(self, codes: np.ndarray) -> np.ndarray:
        if self.find is None:
            self.find = Lookup(self.codes)
        return self.find(codes)

    def types(self, place: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return TOP_TYPES + ending
        known = np.where(place >= 0, self.top[place], -1)
        return np.where(known >= 0, known, TOP_TYPES + ending)

    def leaves(self, place: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Leaves of the tree: places of the dictionary, then endings."""
        return np.where(place >= 0, place, len(self.codes) + ending)

    def __getstate__(self):
        return self.__dict__ | {"find": None}


def _dictionary(total: int):
    least = DICTIONARY_SHARE * total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, items, counts, endings in zip(*(batch.column(c).to_pylist() for c in ("part", "items", "counts", "endings")), strict=True):
                counts, endings = np.frombuffer(counts, dtype=np.int64), np.frombuffer(endings, dtype=np.uint16).astype(np.int32)
                often = counts >= least
                code = scatter.unpack48(items)[often] | (U64(part) << U64(48))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(counts[often]), pa.array(endings[often])], names=["code", "count", "ending"])

    return run


def _rest(counts: Counts):
    """Per ending: the summed counts plus one of tokens that aren't types of their own, those of the dictionary and then the rarer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(2 * ENDINGS)
        for batch in batches:
            for part, items, number, ending in zip(*(batch.column(c).to_pylist() for c in ("part", "items", "counts", "endings")), strict=True):
                code = scatter.unpack48(items) | (U64(part) << U64(48))
                ending, number = np.frombuffer(ending, dtype=np.uint16).astype(np.int64), np.frombuffer(number, dtype=np.int64)
                place = counts.places(code)
                own = counts.types(place, ending) < TOP_TYPES
                mass += np.bincount((ending + ENDINGS * (place < 0))[~own], weights=number[~own] + 1, minlength=2 * ENDINGS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * ENDINGS)), pa.array(mass)], names=["ending", "mass"])

    return run


def _history(types: np.ndarray, at: np.ndarray, back: int) -> np.ndarray:
    """The type so many tokens before each, the start's at a row's beginning."""
    out = np.full(len(types), _START, dtype=np.int64)
    out[back:] = types[:-back] if back < len(types) else types[:0]
    for j in range(back):
        edge = at[:-1] + j
        out[edge[edge < at[1:]]] = _START
    return out


def _beside(counts: Counts):
    """Types by the anchor tokens before and after them, summed over a task's texts, in blocks of types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 2 * ANCHORS
        seen = np.zeros(TYPES * wide, dtype=np.float32)
        for _, _, _, code, ending, at in _slices(batches, counts.ranges):
            types = counts.types(counts.places(code), ending)
            for back in (1, 2):
                other = _history(types, at, back)
                near = other < ANCHORS
                seen += np.bincount(types[near] * wide + other[near], minlength=TYPES * wide)
                here = (types < ANCHORS) & (other != _START)
                seen += np.bincount(other[here] * wide + ANCHORS + types[here], minlength=TYPES * wide)
        rows = seen.reshape(TYPES, wide)
        for i, block in enumerate(np.array_split(rows, _BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.array([i], type=pa.int32()), pa.array([0], type=pa.int32()), pa.array([block.tobytes()], type=pa.binary())], names=["block", "salt", "data"])

    return run


def _add_blocks(table: pa.Table) -> pa.Table:
    """Sum of blocks; of one block and salt, so of a bounded number of tasks."""
    total = None
    for raw in table.column("data"):
        part = np.frombuffer(raw.as_py(), dtype=np.float32)
        total = part.copy() if total is None else total + part
    return pa.Table.from_arrays([table.column("block").slice(0, 1), table.column("salt").slice(0, 1), pa.array([total.astype(np.float32).tobytes()], type=pa.binary())], names=["block", "salt", "data"])


#: Tasks' blocks that are summed together.
_FAN = 64


def _summed(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Blocks of all tasks summed, _FAN at a time."""
    schema = "block int, salt int, data binary"
    blocks = blocks.withColumn("salt", F.spark_partition_id())
    level = blocks.withColumn("salt", (F.col("salt") / _FAN).cast("int")).groupBy("block", "salt").applyInArrow(_add_blocks, schema)
    level = level.withColumn("salt", (F.col("salt") / _FAN).cast("int")).groupBy("block", "salt").applyInArrow(_add_blocks, schema)
    out: dict[int, np.ndarray] = {}
    for r in collected(level):  # a fixed number of blocks for every 4096 tasks
        part = np.frombuffer(bytes(r.data), dtype=np.float32)
        out[r.block] = out[r.block] + part if r.block in out else part
    return out


def cluster(rows: np.ndarray, classes: int, turns: int = 12) -> np.ndarray:
    """Classes of types by the square roots of their neighbour shares (k-means from a spread-out start, reproducible)."""
    mass = rows.sum(axis=1)
    share = np.sqrt((rows + 0.5 * rows.sum(axis=0) / max(rows.sum(), 1)) / (mass + 0.5)[:, None])
    weight = np.sqrt(mass) + 1e-6
    centres = [int(np.argmax(weight))]
    gap = ((share - share[centres[0]]) ** 2).sum(axis=1)
    while len(centres) < min(classes, len(rows)):
        centres.append(int(np.argmax(gap * weight)))
        gap = np.minimum(gap, ((share - share[centres[-1]]) ** 2).sum(axis=1))
    middle = share[centres]
    for _ in range(turns):
        away = (middle**2).sum(axis=1)[None, :] - 2 * share @ middle.T
        belongs = away.argmin(axis=1)
        for c in range(len(middle)):
            own = belongs == c
            if own.any():
                middle[c] = np.average(share[own], axis=0, weights=weight[own])
    return belongs


def hashed_features(types: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of weights for each token's history: last, last two, second last, third last."""
    one, two, three = (_history(types, at, k).astype(U64) for k in (1, 2, 3))
    parts = [wordbuf.mix(one + U64(1 << 40)), wordbuf.mix(one * U64(1 << 20) + two + U64(2 << 40)), wordbuf.mix(two + U64(3 << 40)), wordbuf.mix(three + U64(4 << 40))]
    return (np.stack(parts, axis=1) & U64(FEATURES - 1)).astype(np.int64)


def token_histories(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the tokens' histories by the tokens themselves, a row each: last, last two, second last, third last."""
    one, two, three = (_history(code.view(np.int64), at, k).view(U64) for k in (1, 2, 3))
    first = wordbuf.mix(one + U64(1 << 40))
    return np.stack([first, wordbuf.mix(first + two), wordbuf.mix(two + U64(3 << 40)), wordbuf.mix(three + U64(4 << 40))])


def logits(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Class scores of histories, held within what single-precision exponentials bear."""
    out = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += weights.take(rows[:, k], axis=0)
    out += prior
    return np.clip(out, -60, 60, out=out)


@dataclass
class Tree:
    """Huffman trees of the classes' leaves: dictionary tokens by place, then a leaf for each ending's rarer tokens, then forks."""

    parent: np.ndarray  # -1 at a class's root
    side: np.ndarray  # of the node at its parent, 0 or 1
    prior: np.ndarray  # log of side 1's mass over side 0's, of forks
    leaves: int

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which leaf, fork and side, for every fork above every leaf."""
        who, found = np.arange(len(leaf), dtype=np.int32), []
        while len(leaf):
            up = self.parent[leaf]
            below = up >= 0
            who, leaf, up = who[below], leaf[below], up[below]
            found.append((who, up, self.side[leaf]))
            leaf = up
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (who, who, who)


def grow(mass: np.ndarray, belongs: np.ndarray) -> Tree:
    """A Huffman tree of each class's leaves, by two queues."""
    n = len(mass)
    parent, side, prior = [-1] * n, [0] * n, []
    order = np.lexsort((mass, belongs))
    for own in np.split(order, np.flatnonzero(np.diff(belongs[order])) + 1):
        leaves, weigh = own.tolist(), mass[own].tolist()
        forks: list[int] = []
        heavy: list[float] = []
        i = j = 0
        for _ in range(len(leaves) - 1):
            pair = []
            for _ in range(2):
                if j >= len(forks) or (i < len(leaves) and weigh[i] <= heavy[j]):
                    pair.append((leaves[i], weigh[i]))
                    i += 1
                else:
                    pair.append((forks[j], heavy[j]))
                    j += 1
            (a, x), (b, y) = pair
            fork = len(parent)
            parent.append(-1)
            side.append(0)
            parent[a] = parent[b] = fork
            side[b] = 1
            prior.append(np.log(y / x))
            forks.append(fork)
            heavy.append(x + y)
    return Tree(np.array(parent, dtype=np.int32), np.array(side, dtype=np.int8), np.array(prior, dtype=np.float32), n)


def slot_bits(total: int) -> int:
    least, most = SLOT_BITS
    return min(most, max(least, (total // SLOT_TOKENS).bit_length()))


def fork_slots(histories: np.ndarray, who: np.ndarray, fork: np.ndarray, bits: int) -> np.ndarray:
    """Weights of forks for the histories of their tokens ``who``, one row for each kind of history."""
    slots = histories.take(who, axis=1)
    slots += fork.astype(U64) * U64(0x9E3779B97F4A7C15)
    slots *= U64(0xD6E8FEB86659FD93)
    slots >>= U64(64 - bits)
    return slots.view(np.int64)


def _fork_logits(weights: np.ndarray, slots: np.ndarray, prior: np.ndarray) -> np.ndarray:
    out = weights.take(slots[0])
    for row in slots[1:]:
        out += weights.take(row)
    out += prior
    return np.clip(out, -60, 60, out=out)


@dataclass
class Weights:
    """What training has come to: weights and the sums of squared slopes, of the classes and of the forks."""

    classes: np.ndarray
    class_steep: np.ndarray
    forks: np.ndarray
    fork_steep: np.ndarray

    @staticmethod
    def start(bits: int) -> Weights:
        first = np.float32(1e-2)
        return Weights(np.zeros((FEATURES, CLASSES), dtype=np.float32), np.full((FEATURES, 1), first), np.zeros(1 << bits, dtype=np.float32), np.full(1 << bits, first))

    def averaged(self, blocks: dict[int, np.ndarray]) -> Weights:
        """The tasks' weights, each by how often it has met a feature; features that none has met stay as they are."""
        if not blocks:
            return self
        told = np.concatenate([blocks[i].reshape(-1, CLASSES + 2) for i in range(_BLOCKS)])
        met = told[:, -1:]
        share = told[:, :-1] / np.maximum(met, 1)
        classes, steep = np.where(met > 0, share[:, :-1], self.classes), np.where(met > 0, share[:, -1:], self.class_steep)
        told = np.concatenate([blocks[i].reshape(-1, 3) for i in range(_BLOCKS, 2 * _BLOCKS)])
        met = told[:, 2]
        forks, fork_steep = (np.where(met > 0, told[:, i] / np.maximum(met, 1), x) for i, x in enumerate((self.forks, self.fork_steep)))
        return Weights(*(x.astype(np.float32) for x in (classes, steep, forks, fork_steep)))


class _Inner:
    """A task's fork weights in training."""

    def __init__(self, tree: Tree, start: Weights) -> None:
        self.tree, self.bits = tree, len(start.forks).bit_length() - 1
        self.weights, self.steep = start.forks.copy(), start.fork_steep.copy()
        self.met = np.zeros(len(self.weights), dtype=np.float32)

    def learn(self, leaf: np.ndarray, histories: np.ndarray) -> None:
        for i in range(0, len(leaf), INNER_BATCH):
            who, fork, side = self.tree.paths(leaf[i : i + INNER_BATCH])
            slots = fork_slots(histories[:, i : i + INNER_BATCH], who, fork, self.bits)
            slope = 1 / (1 + np.exp(-_fork_logits(self.weights, slots, self.tree.prior[fork - self.tree.leaves]))) - side
            summed = np.bincount(slots.ravel(), weights=np.tile(slope, len(slots)), minlength=len(self.met)).astype(np.float32)
            self.met += np.bincount(slots.ravel(), minlength=len(self.met))
            self.steep += summed * summed
            summed /= np.sqrt(self.steep)
            summed *= RATE
            self.weights -= summed


def _learn(counts: Counts, classes: np.ndarray, prior: np.ndarray, tree: Tree, start: Weights):
    """Gradient steps over a task's texts -> its weights and slopes times the meetings of each feature, and the meetings, in blocks.

    The classes' blocks come first, then those of the forks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, steep = start.classes.copy(), start.class_steep.copy()
        met = np.zeros(FEATURES, dtype=np.float32)
        inner = _Inner(tree, start)
        for _, _, _, code, ending, at in _slices(batches, counts.ranges):
            place = counts.places(code)
            types = counts.types(place, ending)
            inner.learn(counts.leaves(place, ending), token_histories(code, at))
            wanted, rows = classes[types], hashed_features(types, at)
            for i in range(0, len(types), BATCH):
                which, goal = rows[i : i + BATCH], wanted[i : i + BATCH]
                slope = logits(weights, which, prior)
                np.exp(slope, out=slope)
                slope /= slope.sum(axis=1, keepdims=True)
                slope[np.arange(len(goal)), goal] -= 1
                flat = which.ravel()
                order = np.argsort(flat.astype(np.uint16), kind="stable")
                flat = flat[order]
                starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                by_class = np.ascontiguousarray(slope.T).take(order // which.shape[1], axis=1)
                summed = np.add.reduceat(by_class, starts, axis=1).T  # along classes' rows, which is the quick way
                touched = flat[starts]
                steep[touched] += (summed**2).mean(axis=1, keepdims=True)
                weights[touched] -= RATE * summed / np.sqrt(steep[touched])
                met[touched] += np.diff(np.append(starts, len(flat)))
        told = np.concatenate([weights * met[:, None], steep * met[:, None], met[:, None]], axis=1)
        forks = np.stack([inner.weights * inner.met, inner.steep * inner.met, inner.met], axis=1)
        for i, block in enumerate([*np.array_split(told, _BLOCKS), *np.array_split(forks, _BLOCKS)]):
            yield pa.RecordBatch.from_arrays([pa.array([i], type=pa.int32()), pa.array([0], type=pa.int32()), pa.array([block.tobytes()], type=pa.binary())], names=["block", "salt", "data"])

    return run


@dataclass
class Model:
    counts: Counts
    classes: np.ndarray  # of types
    weights: np.ndarray
    prior: np.ndarray
    size: np.ndarray  # log10 of each class's total, nought where a tree shares out the class
    tree: Tree | None = None
    forks: np.ndarray | None = None  # weights
    rare: np.ndarray | None = None  # log10 of each ending's rarer tokens' total

    def log10_inside(self, leaf: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token's leaf within its class, less the log10 of the total of a rare one's ending."""
        out, histories, bits = np.zeros(len(leaf)), token_histories(code, at), len(self.forks).bit_length() - 1
        for i in range(0, len(leaf), INNER_BATCH):
            who, fork, side = self.tree.paths(leaf[i : i + INNER_BATCH])
            told = _fork_logits(self.forks, fork_slots(histories[:, i : i + INNER_BATCH], who, fork, bits), self.tree.prior[fork - self.tree.leaves])
            np.negative(told, out=told, where=side == 1)
            told = np.log1p(np.exp(told, out=told), out=told)  # logits are held within 60
            out[i : i + INNER_BATCH] = np.bincount(who, weights=told, minlength=len(leaf[i : i + INNER_BATCH])) / -np.log(10)
        other = leaf >= len(self.counts.codes)
        out[other] -= self.rare[leaf[other] - len(self.counts.codes)]
        return out

    def log10_classes(self, types: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class, less the log10 of its class's total."""
        out, wanted, rows = np.zeros(len(types)), self.classes[types], hashed_features(types, at)
        for i in range(0, len(types), BATCH):
            which, goal = rows[i : i + BATCH], wanted[i : i + BATCH]
            told = logits(self.weights, which, self.prior)
            own = told[np.arange(len(goal)), goal].astype(np.float64)
            out[i : i + BATCH] = (own - np.log(np.exp(told, out=told).sum(axis=1, dtype=np.float64))) / np.log(10)
        return out - self.size[wanted]


def fit(docs: DataFrame, ranges: int) -> tuple[Model, DataFrame]:
    """A model of the texts of ``docs`` (``doc_id``, which plays no part in scores, and ``text``), and the count table, one row a hash range."""
    table = durable(docs.mapInArrow(_count(ranges), _TABLE).groupBy("part").applyInArrow(_sum_counts, _TABLE))
    total, kinds = table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    often = table.select("part", "items", "counts", "endings").mapInArrow(_dictionary(total), "code long, count long, ending int").toPandas()  # 1 / DICTIONARY_SHARE rows at most
    code, number = often["code"].to_numpy(dtype=np.int64).view(U64), often["count"].to_numpy(dtype=np.int64)
    order = np.argsort(code)
    code, number, ending = code[order], number[order], often["ending"].to_numpy(dtype=np.int64)[order]
    top = np.full(len(code), -1, dtype=np.int64)
    best = np.lexsort((code, -number))[:TOP_TYPES]
    top[best] = np.arange(len(best))
    counts = Counts(ranges, code, number, top, total, kinds)
    rest = np.zeros(2 * ENDINGS)
    for r in table.mapInArrow(_rest(counts), "ending long, mass double").groupBy("ending").agg(F.sum("mass").alias("mass")).collect():
        rest[r.ending] = r.mass
    mass = np.zeros(TYPES)
    mass[: len(best)] = number[best] + 1
    mass[TOP_TYPES : TOP_TYPES + ENDINGS] = rest[:ENDINGS] + rest[ENDINGS:]
    beside = _summed(docs.mapInArrow(_beside(counts), "block int, salt int, data binary"))
    near = np.concatenate([beside[i].reshape(-1, 2 * ANCHORS) for i in sorted(beside)]) if beside else np.zeros((TYPES, 2 * ANCHORS), dtype=np.float32)
    classes = cluster(near.astype(np.float64), CLASSES)
    size = np.bincount(classes, weights=mass, minlength=CLASSES) + 1.0
    prior = np.log(size / size.sum()).astype(np.float32)
    rare = rest[ENDINGS:] + 1.0
    tree = grow(np.append(number + 1.0, rare), classes[np.append(np.where(top >= 0, top, TOP_TYPES + ending), TOP_TYPES + np.arange(ENDINGS))])
    bits = slot_bits(total)
    learnt = Weights.start(bits)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))  # copies of a text spread over the rounds
    tasks = max(TASKS_LEAST, -(-total // (ROUNDS * TASK_TOKENS)))  # as every task hands in a model
    for k in range(ROUNDS):
        learnt = learnt.averaged(_summed(docs.where(turn == k).coalesce(tasks).mapInArrow(_learn(counts, classes, prior, tree, learnt), "block int, salt int, data binary")))
    return Model(counts, classes, learnt.classes, prior, np.zeros(CLASSES), tree, learnt.forks, np.log10(rare)), table


_PART = "kind int, part int, items binary, counts binary, endings binary, total long, kinds long"


def _score(model: Model):
    """Texts -> header blocks with what is known here (kind 2), and blocks of rarer tokens by hash range (kind 1).

    A header's binaries hold the texts' keys, identifiers (with a null flag) and
    partial sums; a text's key is its slice's number and its row there.
    """
    counts = model.counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch, a, b, code, ending, at in _slices(batches, counts.ranges):
            number += 1
            place = counts.places(code)
            types = counts.types(place, ending)
            told = model.log10_classes(types, at) + model.log10_inside(counts.leaves(place, ending), code, at)
            known = place >= 0
            seen = np.log10(counts.counts[place[known]] + 1.0) if known.any() else np.zeros(0)
            row = np.repeat(np.arange(b - a), np.diff(at))
            key = (U64(number) << U64(20)) | np.arange(b - a, dtype=np.uint64)
            per = lambda x, of=row: np.bincount(of, weights=x, minlength=b - a)  # noqa: B023, E731
            inside = per(seen, row[known])
            ids = batch.column("doc_id").slice(a, b - a)
            header = [np.diff(at).astype(np.float64), np.bincount(row[known], minlength=b - a).astype(np.float64), inside, per(told) - inside]
            rows = [{"kind": 2, "part": number % counts.ranges, "items": key.tobytes(), "counts": np.stack(header).tobytes(), "endings": ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes() + ids.is_null().to_numpy(zero_copy_only=False).tobytes(), "total": number, "kinds": b - a}]
            rare = np.flatnonzero(~known)
            order, bounds = scatter.by_part(code[rare] >> U64(48), counts.ranges)
            rare = rare[order]
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                some = rare[bounds[p] : bounds[p + 1]]
                who, times = scatter.owner_runs(row[some])
                rows.append({"kind": 1, "part": p, "items": scatter.pack48(scatter.low_bits(code[some])), "counts": times.astype(np.uint32).tobytes(), "endings": key[who].tobytes(), "total": number, "kinds": 0})
            yield pa.RecordBatch.from_pylist(rows, schema=_TABLE_ARROW)

    return run


def _answer(ranges: int):
    """A range's count table and rarer tokens -> sums by text (kind 1), and its headers, all by bucket of the slice."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        rows = table.to_pylist()
        own = [r for r, k in zip(rows, kind, strict=True) if k == 0]
        items = scatter.unpack48(own[0]["items"]) if own else np.zeros(0, dtype=U64)
        counts = np.frombuffer(own[0]["counts"], dtype=np.int64) if own else np.zeros(0, dtype=np.int64)
        out = [r | {"part": r["total"] % ranges} for r, k in zip(rows, kind, strict=True) if k == 2]
        for r in (r for r, k in zip(rows, kind, strict=True) if k == 1):
            asked, times = scatter.unpack48(r["items"]), np.frombuffer(r["counts"], dtype=np.uint32)
            found = np.minimum(np.searchsorted(items, asked), max(0, len(items) - 1))
            hit = items[found] == asked if len(items) else np.zeros(len(asked), dtype=bool)
            seen = np.where(hit, np.log10(np.where(hit, counts[found] if len(items) else 0, 0) + 1.0), 0.0)
            starts = np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64)
            sums, known = np.add.reduceat(seen, starts), np.add.reduceat(hit.astype(np.int64), starts)
            some = known > 0
            if some.any():
                keys = np.frombuffer(r["endings"], dtype=U64)
                out.append({"kind": 1, "part": r["total"] % ranges, "items": keys[some].tobytes(), "counts": sums[some].tobytes(), "endings": known[some].astype(np.uint32).tobytes(), "total": r["total"], "kinds": 0})
        return pa.Table.from_pylist(out, schema=_TABLE_ARROW)

    return run


_RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(total: int, kinds: int):
    def run(table: pa.Table) -> pa.Table:
        heads, sums = [], []
        for r in table.to_pylist():
            (heads if r["kind"] == 2 else sums).append(r)
        out = []
        by_slice: dict[int, list[dict]] = {}
        for r in sums:
            by_slice.setdefault(r["total"], []).append(r)
        for r in heads:
            n = r["kinds"]
            tokens_, known, inside, told = np.frombuffer(r["counts"], dtype=np.float64).reshape(4, n).copy()
            for s in by_slice.get(r["total"], []):
                at = (np.frombuffer(s["items"], dtype=U64) & U64((1 << 20) - 1)).astype(np.int64)
                inside[at] += np.frombuffer(s["counts"], dtype=np.float64)
                known[at] += np.frombuffer(s["endings"], dtype=np.uint32)
            ids, null = np.frombuffer(r["endings"][: 8 * n], dtype=np.int64), np.frombuffer(r["endings"][8 * n :], dtype=bool)
            whole = lambda x: pa.array(x.astype(np.int64))
            arrays = [pa.array(ids, mask=null), whole(tokens_), whole(known), whole(np.full(n, total)), pa.array(inside - tokens_ * np.log10(total + kinds + 1.0)), pa.array(inside + told)]
            out.append(pa.RecordBatch.from_arrays(arrays, schema=_RESULT_ARROW))
        return pa.Table.from_batches(out, schema=_RESULT_ARROW)

    return run


def score(docs: DataFrame, learnt: Column) -> DataFrame:
    """Scores of every whole text of ``docs`` by a model of those for which ``learnt`` holds.

    docs has ``doc_id`` (long) and ``text``.  Gives ``doc_id``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams) and ``score``
    (the model), both as log10 probabilities of the text, however long it is.
    Other columns of docs are left aside, whatever their names.  Null texts read as
    empty, which is the end mark alone; repeated rows and identifiers are scored
    row by row, null identifiers stay null.  Without training texts every token
    is unseen.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    octets = F.octet_length(F.coalesce("text", F.lit("")))
    most = docs.agg(F.sum(((octets + 1) / 2).cast("long") + 1)).first()[0] or 0  # tokens, if every other byte parts two words
    ranges = scatter.ranges_for(most, width(spark))
    model, table = fit(docs.where(learnt), ranges)
    blocks = docs.mapInArrow(_score(model), _PART).unionByName(table)
    answers = blocks.groupBy("part").applyInArrow(_answer(ranges), _PART)
    return answers.groupBy("part").applyInArrow(_finish(model.counts.total, model.counts.kinds), _RESULT)
