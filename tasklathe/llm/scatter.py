"""Shuffling hashed items in packed blocks instead of rows.

A map task turns the items of some owners (the shingles of documents, say) into
one block per hash range: the owners' keys and, for each, how many of its items
fall in the range and the items' low 48 bits.  A range's reducer gets every
block of its range, so it sees all owners of an item together.  An item costs 6
bytes in the shuffle, against some 25 as a Spark row, and nothing is handled
item by item in Python.

The number of ranges follows the data (``ranges_for``), so a reducer holds a
bounded number of items at any input size.
"""

from __future__ import annotations

import numpy as np

from .wordbuf import U64

#: Items that one range should hold on average.
ITEMS_A_RANGE = 3_000_000
_LOW = U64((1 << 48) - 1)


def ranges_for(items: int, least: int) -> int:
    """Hash ranges for so many items; ranges are numbered by the top 16 bits at most."""
    return min(1 << 16, max(least, -(-items // ITEMS_A_RANGE)))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit hash, from its top 16 bits."""
    return ((hashes >> U64(48)) * U64(ranges)) >> U64(16)


def low_bits(hashes: np.ndarray) -> np.ndarray:
    return hashes & _LOW


def pack48(low: np.ndarray) -> bytes:
    """48-bit values as two planes: all low 32-bit halves, then all high 16-bit halves."""
    return (low & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low >> U64(32)).astype(np.uint16).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    lower = np.frombuffer(raw, dtype=np.uint32, count=n).astype(U64)
    return lower | (np.frombuffer(raw, dtype=np.uint16, count=n, offset=4 * n).astype(U64) << U64(32))


def by_part(parts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the items by part, and each part's start in it (one more at the end)."""
    order = np.argsort(parts.astype(np.uint16 if count <= 1 << 16 else np.int64), kind="stable")
    sizes = np.bincount(parts.astype(np.int64), minlength=count)
    return order, np.concatenate([[0], np.cumsum(sizes)])


def owner_runs(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct consecutive owners and their run lengths."""
    if not len(owners):
        return owners, np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    return owners[starts], np.diff(np.concatenate([starts, [len(owners)]]))
