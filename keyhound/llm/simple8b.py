"""Simple-8b: varying counts of values in each 64-bit word, coded and decoded by numpy.

A word's top four bits select how the other sixty are used: n values of w bits each, first value lowest
(`SELECTORS`), one value of 60 bits, or an escape (selector 0): the next word holds one whole 64-bit value.
Values are coded in blocks of `BLOCK`; a block's words depend on no other block's, and the offset of each
block's first word is kept, so that any block can be decoded alone and all blocks at once.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: values in a word and bits of each, for selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0
BLOCK = 256
_COUNTS = np.array([1] + [n for n, _ in SELECTORS], dtype=np.int64)
_WIDTHS = np.array([64] + [w for _, w in SELECTORS], dtype=np.int64)


def _bits(values: np.ndarray) -> np.ndarray:
    """The narrowest width that holds each value; 64 for those that need an escape."""
    bits, narrower = np.zeros(len(values), dtype=np.int8), 0
    for w in sorted(w for _, w in SELECTORS):
        bits[values >> np.uint64(narrower) > 0] = w
        narrower = w
    bits[values >> np.uint64(60) > 0] = 64
    return bits


_BITS16 = _bits(np.arange(1 << 16, dtype=np.uint64))


def _choices(values: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The selector that takes most values from each position on; limit: values left in its block."""
    n = len(values)
    selector = np.full(n, ESCAPE, dtype=np.int8)
    bits = _BITS16[values] if int(values.max()) < 1 << 16 else _bits(values)
    # most[i]: the widest of `span` values from i on, grown from window to window.
    most, span = bits.copy(), 1
    for k in range(len(SELECTORS), 0, -1):
        count, width = SELECTORS[k - 1]
        while span < count:
            step = min(span, count - span)
            most[: n - step] = np.maximum(most[: n - step], most[step:])
            span += step
        fits = (most <= width) & (limit >= count)
        if not fits.any():
            break  # more and narrower values fit nowhere either
        selector[fits] = k
    return selector


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (uint64) and, for each block, the offset of its first word (uint32)."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    limit = BLOCK - np.arange(n) % BLOCK
    limit = np.minimum(limit, n - np.arange(n)).astype(np.int16)
    selector = _choices(values, limit)
    step = _COUNTS[selector]
    heads = np.zeros(n, dtype=bool)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):  # all blocks at once, a word of each at a time
        heads[at] = True
        at = at + step[at]
        open_ = at < ends
        at, ends = at[open_], ends[open_]
    heads = np.flatnonzero(heads)
    sel = selector[heads]
    size = 1 + (sel == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    for k, (count, width) in enumerate(SELECTORS, 1):
        own = sel == k
        if own.any():
            h = heads[own]
            word = np.full(len(h), k << 60, dtype=np.uint64)
            for j in range(count):
                word |= values[h + j] << np.uint64(j * width)
            words[place[own]] = word
    own = sel == ESCAPE
    words[place[own] + 1] = values[heads[own]]
    first = np.searchsorted(heads, np.arange(0, n, BLOCK))
    return words, place[first].astype(np.uint32)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks' words, as uint64."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE):  # in order: a raw word may look like an escape itself
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    sel = sel[heads]
    counts = _COUNTS[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), dtype=np.uint64)
    for k, (count, width) in enumerate(SELECTORS, 1):
        own = sel == k
        if own.any():
            w, to = words[heads[own]], (ends - counts)[own]
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[to + j] = w >> np.uint64(j * width) & mask
    own = sel == ESCAPE
    out[(ends - counts)[own]] = words[heads[own] + 1]
    if len(out) != n:
        raise ValueError(f"{len(out)} values where {n} should be")
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """One block's values, by its offset alone."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode(words[offsets[block] : end], min(BLOCK, n - block * BLOCK))


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of all blocks, decoded side by side: each step takes one word of every block, from its offset on."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    blocks = -(-n // BLOCK)
    if len(offsets) != blocks:
        raise ValueError(f"{len(offsets)} blocks where {blocks} should be")
    at, to = offsets.astype(np.int64), np.arange(blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(to + BLOCK, n)
    heads, firsts = [], []
    while len(at):
        heads.append(at)
        firsts.append(to)
        sel = (words[at] >> np.uint64(60)).astype(np.int64)
        to = to + _COUNTS[sel]
        at = at + 1 + (sel == ESCAPE)
        on = to < ends
        if (to > ends).any():
            raise ValueError("a block's words run past its end")
        at, to, ends = at[on], to[on], ends[on]
    if not heads:
        return out
    heads, firsts = np.concatenate(heads), np.concatenate(firsts)
    sel = (words[heads] >> np.uint64(60)).astype(np.int64)
    for k, (count, width) in enumerate(SELECTORS, 1):
        own = sel == k
        if own.any():
            w, first = words[heads[own]], firsts[own]
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[first + j] = w >> np.uint64(j * width) & mask
    own = sel == ESCAPE
    out[firsts[own]] = words[heads[own] + 1]
    return out
