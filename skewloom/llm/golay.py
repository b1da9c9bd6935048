"""The perfect (23, 12) Golay code: syndromes, coset leaders and codewords within distance four.

Any 23-bit word lies within distance three of exactly one codeword. A word at distance exactly three
has five more codewords at distance four, any other word none; so a word has one or six codewords
within distance four. Two words at distance one or two always have one of these in common.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits; per syndrome the leader, five words of weight four, and whether it has them."""
    low = np.array([_remainder(v) for v in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], dtype=np.int64)
    leader = np.full(1 << 11, -1, dtype=np.int64)
    fours: dict[int, list[int]] = {}
    for weight in range(5):
        for at in combinations(range(23), weight):
            v = sum(1 << b for b in at)
            s = int(low[v & 0xFFF] ^ high[v >> 12])
            if leader[s] < 0:
                leader[s] = v
            elif weight == 4:
                fours.setdefault(s, []).append(v)
    more = np.zeros((1 << 11, 5), dtype=np.int64)
    has = np.zeros(1 << 11, dtype=bool)
    for s, v in fours.items():
        more[s], has[s] = v, True
    return low, high, leader, more, has


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within distance four, six columns with the nearest first, and which are set."""
    low, high, leader, more, has = tables()
    v = v.astype(np.int64)
    s = low[v & 0xFFF] ^ high[v >> 12]
    near = (v ^ leader[s]) >> 11
    rest = (v[:, None] ^ more[s]) >> 11
    return np.column_stack([near, rest]), np.column_stack([np.ones(len(v), bool), np.repeat(has[s][:, None], 5, 1)])
