"""The perfect binary Golay code of length 23, vectorised over numpy arrays.

Every 23-bit word lies within three bits of exactly one of 4,096 codewords, so
decoding is total; a codeword is named by its upper 12 bits.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit, and the error pattern of each syndrome."""
    rest = np.zeros(LENGTH, np.int64)
    r = 1
    for i in range(LENGTH):
        rest[i] = r
        r <<= 1
        if r >> CHECK_BITS:
            r ^= GENERATOR
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce(rest[list(bits)])] = sum(1 << b for b in bits)
    return rest, errors


def syndrome(words: np.ndarray) -> np.ndarray:
    rest, _ = _tables()
    out = np.zeros(words.shape, np.int64)
    for i in range(LENGTH):
        out ^= np.where((words >> i) & 1, rest[i], 0)
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the nearest codeword."""
    _, errors = _tables()
    return (words ^ errors[syndrome(words)]) >> CHECK_BITS


def near_indices(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords nearest to each word and to each word one bit away.

    Shape (n, 24), the word's own first; six values differ at most.  The own index
    of a word is among these for any word at distance one or less.
    """
    rest, errors = _tables()
    base = syndrome(words)
    cols = [(words ^ errors[base]) >> CHECK_BITS]
    cols += [((words ^ (1 << i)) ^ errors[base ^ rest[i]]) >> CHECK_BITS for i in range(LENGTH)]
    return np.stack(cols, axis=1)
