"""Columns of text as blocks of bytes, and the word-level numpy steps several operators share.

A block holds whole documents: about ``BLOCK_BYTES`` of them, or one longer document.  Every step
works on all documents of a block at once, so the work per document is a few numpy passes and
memory is bounded by the block and by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Block(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each document starts and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    data, at = _buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Block(lo, hi, data[at[lo] : at[hi]], at[lo:hi] - at[lo], at[lo + 1 : hi + 1] - at[lo])
        lo = hi


class Words(NamedTuple):
    """Words of a block: where each starts and ends, its document, and the number of each document's first word."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, inside: np.ndarray) -> Words:
    """Maximal runs of bytes whose entry in ``inside`` (256 booleans) is true; none crosses documents."""
    n = len(block.data)
    mask = np.zeros(n + 1, bool)
    mask[:n] = inside[block.data]
    edge = np.empty(n + 1, bool)
    edge[0] = mask[0]
    np.not_equal(mask[1:], mask[:-1], out=edge[1:])
    cut = block.starts[(block.starts > 0) & (block.starts < n)]
    cut = np.unique(cut[mask[cut] & mask[cut - 1]])  # a word goes on in the next document: part them
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[0::2], at[1::2]
    first = np.append(np.searchsorted(starts, block.starts), len(starts))
    first = np.minimum.accumulate(first[::-1])[::-1]
    return Words(starts, ends, np.repeat(np.arange(len(block.starts)), np.diff(first)), first)


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """Powers of ``base``; those of one block are kept, as many as a longer document needs are not."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > BLOCK_BYTES + 1:
            return out
        have = _powers[name] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits; one-to-one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial in the bytes, mixed; equal bytes give equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", _INVERSE, len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` successive hashes, as many as fit."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xA0761D6478BD642F) + hashes[k : k + n]
    return mix(out)


def windows(w: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside one document, and the number of each window's first word."""
    value = window_hashes(hashes, width)
    at = np.flatnonzero(w.doc[: len(value)] == w.doc[width - 1 : width - 1 + len(value)]) if len(value) else np.zeros(0, np.int64)
    return value[at], at


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [start, end)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def fold_case(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def table(chars: bytes = b"", high: bool = False) -> np.ndarray:
    """256 booleans, true for these bytes, and for those from 0x80 up if ``high``."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    out[128:] = high
    return out
