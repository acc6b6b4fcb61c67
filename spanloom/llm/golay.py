"""The perfect binary Golay code: every 23-bit word lies within 3 bits of exactly one of 4096 codewords."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def remainder(words: np.ndarray) -> np.ndarray:
    """Of the words as polynomials, divided by the generator: 0 for codewords."""
    left = words.astype(np.int64).copy()
    for bit in range(BITS - 1, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << bit - 11, 0)
    return left


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 and the lower 11 bits, and the error that each remainder stands for."""
    upper, lower = remainder(np.arange(1 << 12) << 11), remainder(np.arange(1 << 11))
    errors = np.zeros(1 << 11, np.int64)
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(BITS), n)], np.int64)
    errors[remainder(patterns)] = patterns
    return upper, lower, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword: its upper 12 bits."""
    upper, lower, errors = tables()
    words = words.astype(np.int64)
    return (words ^ errors[upper[words >> 11] ^ lower[words & 0x7FF]]) >> 11


def around(words: np.ndarray) -> np.ndarray:
    """A row of 24 indices for each word: its own, and those of the words one bit away; at most 6 of them differ.

    Words at most 1 bit apart: the first's own index is among the second's row. At most 2 bits: the rows share one.
    """
    words = words.astype(np.int64)
    return decode(np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(BITS))], axis=1))
