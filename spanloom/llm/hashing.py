"""Vectorised hashes of words: of many texts at once, one number a character."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from spanloom.llm.common import forget_with

#: The multipliers of the splitmix64 finaliser, and an odd base and its inverse.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def folded(letters: bool = False) -> np.ndarray:
    """The lower-case code point of letters (and digits), 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha() or not letters and char.isalnum():
            out[point] = ord(char.lower()[0])
    return out


_powers: dict[int, np.ndarray] = {}


def power(base: int, size: int) -> np.ndarray:
    """base**0 to base**(size - 1), modulo 2**64."""
    if base not in _powers or len(_powers[base]) < size:
        steps = np.full(max(size, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:size]


forget_with(_powers.clear)
forget_with(folded.cache_clear)
