"""Vectorised word and shingle hashing over Arrow string buffers.

All functions work on the UTF-8 bytes of a whole Arrow column at once, so no
Python runs per word.  A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; these separators are ASCII and never occur inside a
multi-byte UTF-8 sequence, so byte runs and character runs are the same.
Letters A-Z are folded to a-z and no others.

Hashes are 64-bit: a polynomial over the word's bytes modulo 2**64, mixed with
the word's length by a bijective finaliser.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_LIBC = ctypes.CDLL(None)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                powers = np.full(size, base, dtype=U64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U64))


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    h = h ^ (h >> U64(32))
    h = h * _STEP
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the int64 offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (one row at least), so temporaries stay small."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


#: Bytes of letters and digits, and of anything beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def pieces(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``most`` bytes with their bytes and offsets; only one range is held at a time."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    for a, b in blocks(offsets, most):
        yield a, b, *utf8(column.slice(a, b - a))


def give_back() -> None:
    """Return memory that a worker's task no longer uses to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker keeps from task to task, by the operator that keeps it.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this worker keeps from task to task for ``operator``; what it kept for any other goes, its memory to the system."""
    others = [x for x in _KEPT if x != operator]
    if others:
        for other in others:
            del _KEPT[other]
        gc.collect()
        give_back()
    return _KEPT.setdefault(operator, {})


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one more at the end).

    ``inside`` tells for each byte whether words hold it.
    """
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    if len(data):
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        edges = offsets[:-1][offsets[1:] > offsets[:-1]]
        first[edges] = mask[edges]
        tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[tails] = mask[tails]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word given by its byte range."""
    _POWERS.reach(len(data) + 1)
    value = (_LOWER[data] if fold else data).astype(U64)
    value += U64(1)
    value *= _POWERS.up[: len(data)]
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(value, out=total[1:])
    h = (total[end] - total[begin]) * _POWERS.down[begin]
    return mix(h + (end - begin).astype(U64) * U64(0xA0761D6478BD642F))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items that start at each position (positions 0 to len - k)."""
    out = np.full(max(0, len(hashes) - k + 1), U64(k))
    for j in range(k):
        out *= _STEP
        out += hashes[j : j + len(out)]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row of fewer than k words has its whole sequence as its only shingle; a
    row without words has none.
    """
    begin, end, at = words(data, offsets)
    hashed = word_hashes(data, begin, end)
    full = runs(hashed, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(runs(hashed[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
