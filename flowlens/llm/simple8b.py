"""Simple-8b: unsigned integers packed into 64-bit words, in blocks that decode on their own.

A word is a selector of four bits (the top ones) and 60 bits of payload.  The
selector says how many values the word holds and how many bits each takes, first
value lowest.  Values past 60 bits are escaped: one word carries their low 60 bits
and the next, under a selector of its own, the rest.  So every word starts with a
selector and no word's meaning hangs on a scan of those before it.

Values go in blocks of ``BLOCK``; a block starts on a word, so with the offsets of
the blocks all of them are packed, and unpacked, side by side in NumPy.
"""

from __future__ import annotations

import numpy as np

#: Values of a block.
BLOCK = 128
#: Payload bits of a word, and bits of a value under selectors 2 to 15.
PAYLOAD = 60
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: A value's low 60 bits; the high bits of the value before.
ESCAPE, HIGH = 0, 1
_COUNTS = np.array([1, 0, *(PAYLOAD // w for w in WIDTHS)], np.int64)
_U8 = np.uint64


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes, one at least."""
    high = values >> _U8(32)
    bits = np.frexp((values & _U8(0xFFFFFFFF)).astype(np.float64))[1].astype(np.int8)
    if high.any():
        bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1].astype(np.int8) + np.int8(32), bits)
    return np.maximum(bits, 1)


def _choose(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a word that starts at each value: its selector, and how many values it takes."""
    n, blocks = len(values), -(-len(values) // BLOCK)
    # a row for each block; what lies past its end takes no bits
    bits = np.zeros((blocks, BLOCK + PAYLOAD), np.int8)
    bits[:, :BLOCK] = np.resize(np.concatenate([_bits(values), np.zeros(blocks * BLOCK - n, np.int8)]), (blocks, BLOCK))
    # widest[k]: the widest of the k values from each place on
    widest = {1: bits}
    needed = sorted({int(c) for c in _COUNTS[2:]})
    for c in needed[1:]:
        k = max(widest)  # two windows of k cover c, as counts at most double
        widest[c] = np.maximum(widest[k][:, :k - c], widest[k][:, c - k:])
    # what fits one selector fits all that follow it, which hold fewer and wider values
    selector = np.full((blocks, BLOCK), 2, np.int8)
    for s, width in enumerate(WIDTHS, 2):
        selector += widest[int(_COUNTS[s])][:, :BLOCK] > width
    selector[selector == len(_COUNTS)] = ESCAPE
    left = np.tile(np.arange(BLOCK, 0, -1, dtype=np.int16), (blocks, 1))
    left[-1] -= np.int16(blocks * BLOCK - n)
    taken = np.minimum(_COUNTS.astype(np.int16)[selector], left)
    return selector.ravel()[:n], taken.ravel()[:n]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the words of each block; the last block may be short."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    selector, taken = _choose(values)
    # walk all blocks at once, a word a step
    first = np.arange(0, n, BLOCK)
    last = np.minimum(first + BLOCK, n)
    now, going, starts = first.copy(), np.arange(len(first)), []
    while len(going):
        starts.append(now[going])
        now[going] += taken[now[going]]
        going = going[now[going] < last[going]]
    start = np.sort(np.concatenate(starts))
    chosen, held = selector[start], taken[start]
    words = chosen.astype(np.uint64) << _U8(PAYLOAD)
    for s, width in enumerate(WIDTHS, 2):
        rows = np.nonzero(chosen == s)[0]
        count, first_value = int(_COUNTS[s]), start[rows]
        short = held[rows] < count  # a block's last word; past its end any value is at hand, and masked
        part = words[rows]
        for j in range(count if len(rows) else 0):
            value = values[np.minimum(first_value + j, n - 1)] << _U8(width * j)
            value[short & (held[rows] <= j)] = 0
            part |= value
        words[rows] = part
    escaped = np.nonzero(chosen == ESCAPE)[0]
    low = values[start[escaped]] & _U8((1 << PAYLOAD) - 1)
    words[escaped] |= low
    high = (_U8(HIGH) << _U8(PAYLOAD)) | (values[start[escaped]] >> _U8(PAYLOAD))
    per_block = np.bincount(start // BLOCK, minlength=len(first)) + np.bincount(start[escaped] // BLOCK, minlength=len(first))
    return np.insert(words, escaped + 1, high), per_block


def unpack(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks, given the words of each block."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> _U8(PAYLOAD)).astype(np.int64)
    payload = words & _U8((1 << PAYLOAD) - 1)
    held = _COUNTS[selector]
    block = np.repeat(np.arange(len(per_block)), per_block)
    before = np.concatenate([[0], np.cumsum(held)])[:-1]
    first_word = np.concatenate([[0], np.cumsum(per_block)])[:-1]
    # slots past a block's end are padding of its last word
    start = block * BLOCK + before - before[np.minimum(first_word, len(words) - 1)][block]
    end = np.minimum((block + 1) * BLOCK, n)
    for s, width in enumerate(WIDTHS, 2):
        rows = np.nonzero(selector == s)[0]
        mask = _U8((1 << width) - 1)
        for j in range(int(_COUNTS[s])):
            rows = rows[start[rows] + j < end[rows]]
            if not len(rows):
                break
            out[start[rows] + j] = (payload[rows] >> _U8(width * j)) & mask
    rows = np.nonzero(selector == ESCAPE)[0]
    out[start[rows]] = payload[rows]
    rows = np.nonzero(selector == HIGH)[0]
    out[start[rows] - 1] |= payload[rows] << _U8(PAYLOAD)
    return out
