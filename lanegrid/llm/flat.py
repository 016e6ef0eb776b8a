"""Word spans and hashes of whole Arrow text columns, computed on the flat UTF-8 buffer.

The helpers work on the bytes of many texts at once, so a task's cost is a few numpy passes
and no Python loop over words. All hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix64 = _mix
BYTE_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x2545F4914F6CDD1D)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about ``limit`` text bytes; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and where each starts (one more entry than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes outside ``separators``."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[data]
    edge = at[:-1][at[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = edge[edge > 0] - 1
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at[1:], start, side="right")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """A hash of each span's bytes: sum of byte values times powers of an odd base, finalised with the length; 0 for an empty span."""
    if (some := end > start).all():
        return _hash_spans(data, start, end, limit)
    out = np.zeros(len(start), np.uint64)
    out[some] = _hash_spans(data, start[some], end[some], limit)
    return out


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + limit, side="right")))
        size = (end[i:j] - start[i:j]).astype(np.int64)
        total = int(size.sum())
        if total > 4 * limit:  # one very long span, in pieces
            h, scale = np.uint64(0), np.uint64(1)
            power = np.cumprod(np.full(limit, _BASE, np.uint64), dtype=np.uint64)
            for p in range(int(start[i]), int(end[i]), limit):
                part = BYTE_VALUE[data[p : min(p + limit, int(end[i]))]]
                with np.errstate(over="ignore"):
                    h = h + (part * power[: len(part)]).sum(dtype=np.uint64) * scale
                    scale = scale * power[len(part) - 1]
            out[i] = h
        else:
            first = np.zeros(j - i, np.int64)
            np.cumsum(size[:-1], out=first[1:])
            within = np.arange(total, dtype=np.int64) - np.repeat(first, size)
            power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
            value = BYTE_VALUE[data[np.repeat(start[i:j], size) + within]] * power[within]
            out[i:j] = np.add.reduceat(value, first)
        i = j
    return _mix(out ^ (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` consecutive values of one owner, and the index at which it starts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= _BASE
        h += values[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return _mix(h[at]), at


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise array over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
