"""Whole texts as numpy blocks: Arrow buffers in, word positions and rolling hashes out.

A block is a run of documents of about ``BLOCK_BYTES`` (one longer document is a
block by itself), so a task's memory is bounded by the block or by its longest
document. Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 these separators are single
bytes that occur in no other character, so words can be found in the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MULTIPLIER = 0x9E3779B97F4A7C55          # odd, so it has an inverse modulo 2^64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, offsets, bytes) for runs of rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()).fill_null(
        b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1, lo + 1)
        yield lo, offsets[lo:hi + 1] - offsets[lo], raw[offsets[lo]:offsets[hi]]
        lo = hi


class Powers:
    """Powers of an odd multiplier and of its inverse, grown on demand."""

    def __init__(self, multiplier: int = MULTIPLIER):
        self.m, self.inv, self.n = multiplier, pow(multiplier, -1, 1 << 64), 0
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            out = []
            for m in (self.m, self.inv):
                p = np.full(self.n, np.uint64(m))
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


POWERS: dict[int, Powers] = {}


def prefix_hash(values: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[i..j) times rising powers; see range_hash."""
    up, _ = POWERS.setdefault(multiplier, Powers(multiplier)).get(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """64-bit hash of values[start..end), independent of where the range lies."""
    _, down = POWERS.setdefault(multiplier, Powers(multiplier)).get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row) of all words of a block; words end with their row."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(BYTE_VALUES[raw]), start, end)


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest key (the leftmost of equals) in keys[i..i+width) for each i.

    Compares the upper 36 bits of the keys; equal windows give equal relative indexes."""
    n = len(keys)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    k = (keys & ~low) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    k = np.concatenate([k, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(k, axis=1).ravel()
    back = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1:width - 1 + m]) & low).astype(np.int64)


def by_row_and_hash(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Order by row, then hash."""
    order = np.argsort(h)
    return order[np.argsort(row[order].astype(np.uint16 if rows < 1 << 16 else np.uint32), kind="stable")]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[i]..start[i]+size[i] of all i, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
