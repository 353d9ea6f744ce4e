"""Simple-8b: ids packed into 64-bit words, for whole blocks at a time in numpy.

A word is a selector (the top 4 bits) and 60 bits of data: as many values as fit, all in the
selector's width, the first one lowest. Selector 15 is an escape: the next word is one value of up
to 64 bits as it is. A block is BLOCK values (the last of a run may be short) and starts on a word,
so blocks are coded and decoded side by side. A block's last word may have room for more values
than there are; the count says where it ends.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Values in a word by selector, most first, and their width in bits. Selectors 0 and 1 are runs of zeros.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64])
ESCAPE = 15


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the first word of each block (one more at the end)."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    # blocks side by side; what a block lacks reads as zeros, which fit any selector
    wide = BLOCK + COUNT[0]
    padded = np.zeros((blocks, wide), np.uint64)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        padded[whole, : n - whole * BLOCK] = values[whole * BLOCK :]
    bits = np.frexp(padded.astype(np.float64))[1].astype(np.uint8)
    # widest value of the next 1, 2, ... values; of the selectors that hold them all the fullest counts
    choice, widest = np.full((blocks, BLOCK), ESCAPE, np.uint8), bits[:, :BLOCK].copy()
    for s in range(ESCAPE, -1, -1):
        for k in range(COUNT[min(s + 1, ESCAPE)], COUNT[s]):
            np.maximum(widest, bits[:, k : k + BLOCK], out=widest)
        if s < ESCAPE:
            choice[widest <= WIDTH[s]] = s
            if s and widest.min() > WIDTH[s - 1]:
                break
    # the k-th word of all blocks at a time
    choice, step = choice.reshape(-1), COUNT[choice].reshape(-1)
    size = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    row, at, starts = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(row):
        cell = row * BLOCK + at
        starts.append((row, at))
        at = at + step[cell]
        open_ = at < size[row]
        row, at = row[open_], at[open_]
    row, at = np.concatenate([r for r, _ in starts]), np.concatenate([a for _, a in starts])
    used = choice[row * BLOCK + at]
    # words of a block stand in order of their values
    length = np.where(used == ESCAPE, 2, 1)
    filled = np.zeros(blocks * BLOCK + 1, np.int64)
    filled[row * BLOCK + at + 1] = length
    np.cumsum(filled, out=filled)
    place, words = filled[row * BLOCK + at], np.zeros(int(filled[-1]), np.uint64)
    words[place] = used.astype(np.uint64) << np.uint64(60)
    padded, first = padded.reshape(-1), row * wide + at
    for s in range(2, ESCAPE):
        own = np.flatnonzero(used == s)
        if len(own):
            one, source = words[place[own]], first[own]
            for j in range(COUNT[s]):
                one |= padded[source + j] << np.uint64(j * WIDTH[s])
            words[place[own]] = one
    own = used == ESCAPE
    words[place[own] + 1] = padded[first[own]]
    return words, np.append(filled[np.arange(blocks) * BLOCK], len(words))


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of blocks whose first words are at ``offsets``."""
    blocks = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # a raw value may look like an escape; an odd place after the start of a run of such words is raw
    seems = np.flatnonzero(selector == ESCAPE)
    if len(seems):
        after = _raw_places(seems, offsets)
        raw[after] = True
    count = np.where(raw, 0, COUNT[selector])
    total = np.r_[0, np.cumsum(count)]
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    # the last word of a block may hold fewer values than its selector says
    at = total[:-1] - total[offsets[block]] + block * BLOCK
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)[block]
    for s in range(2, ESCAPE):
        own = np.flatnonzero((selector == s) & ~raw)
        if len(own):
            mask = np.uint64((1 << int(WIDTH[s])) - 1)
            for j in range(COUNT[s]):
                keep = own[at[own] + j < ends[own]]
                out[at[keep] + j] = (words[keep] >> np.uint64(j * WIDTH[s])) & mask
    own = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[at[own]] = words[own + 1]
    return out


def _raw_places(seems: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of raw values: each follows a word that is an escape and not itself raw."""
    out, last = [], -1
    for i in seems.tolist():
        if i != last:  # else it is itself a raw value
            out.append(i + 1)
            last = i + 1
    return np.array(out)
