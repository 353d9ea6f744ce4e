"""Words and word shingles of Arrow text columns, hashed by numpy without a loop over words.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). Bytes of a longer
UTF-8 character are never white space, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; the arrays over it take about 30 times as much.
SLICE_BYTES = 1 << 19
#: Words that are hashed at a time.
_STEP = 100_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, _STEP * 8), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    offsets = offsets.astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text; a longer text is alone."""
    _, offsets = buffers(batch[column])
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[edge - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``lower`` reads A-Z as a-z."""
    table, out = _LOWER if lower else _BYTE, np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _STEP):
        s, e = starts[i : i + _STEP], ends[i : i + _STEP]
        lo, hi = int(s[0]), int(e[-1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * _power(_P, hi - lo), out=total[1:])
        value = (total[e - lo] - total[s - lo]) * _power(pow(_P, -1, 1 << 64), hi - lo)[s - lo]
        out[i : i + _STEP] = mix(value + (e - s).astype(np.uint64) * _Q)
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.full(m, n, np.uint64)
    for j in range(n):
        total = total * _Q + hashes[j : j + m]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, spanned: tuple | None = None) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text, A-Z read as a-z.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    ``spanned`` is what ``spans`` gave, where a caller has it.
    """
    starts, ends, first = spanned or spans(data, offsets)
    hashes = span_hashes(data, starts, ends, lower=True)
    runs = shingles(hashes, n)
    for d in range(len(offsets) - 1):
        i, j = int(first[d]), int(first[d + 1])
        if j - i >= n:
            found = np.sort(runs[i : j - n + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        else:
            yield shingles(hashes[i:j], j - i) if j > i else hashes[:0]
