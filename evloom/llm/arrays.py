"""Whole Arrow batches of text as numpy arrays: words, hashes and sliding minima without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def join_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of a pair, order counting."""
    return mix(x * U(0xD6E8FEB86659FD93) + (y ^ (y >> U(30))) * U(0xA5A3564E2C9A1B0F) + U(0x632BE59BD9B4E019))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in a row, and where each row starts (one more entry than rows). Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def longs(column: pa.Array) -> np.ndarray:
    """A column of 64-bit integers without nulls."""
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that each holds about ``size`` bytes of text (a longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, U)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of bytes outside ``breaks``: hashes, first bytes, and each row's first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    if lower:
        data = LOWER[data]
    inside = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_TABLE[data] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))
    return h, start, np.searchsorted(start, off)


def grams(x: np.ndarray, k: int, levels: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of all runs of k neighbours, by doubling. ``levels`` keeps and reuses the powers of two."""
    levels = {} if levels is None else levels
    levels.setdefault(1, x)
    size = 1
    while size * 2 <= k:
        if size * 2 not in levels:
            y = levels[size]
            levels[size * 2] = join_hash(y[: max(0, len(y) - size)], y[size:])
        size *= 2
    y = levels[size]
    return y if size == k else join_hash(y[: max(0, len(x) - k + 1)], y[k - size : k - size + max(0, len(x) - k + 1)])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    out, size = x, 1
    while size * 2 <= w:
        out = np.minimum(out[: max(0, len(out) - size)], out[size:])
        size *= 2
    n = max(0, len(x) - w + 1)
    return np.minimum(out[:n], out[w - size : w - size + n])


def inside(off: np.ndarray, n: int, w: int) -> np.ndarray:
    """Which of the n symbols start a run of w symbols that ends in the same row."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, off[:-1], 1)
    np.add.at(step, np.maximum(off[:-1], off[1:] - w + 1), -1)
    return np.cumsum(step[:n]) > 0


def row_sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x over each row's range."""
    total = np.zeros(len(x) + 1, np.float64)
    np.cumsum(x, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
