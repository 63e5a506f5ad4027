"""The binary Golay code of length 23: every 23-bit value is within 3 bits of exactly one codeword."""

from __future__ import annotations

import functools
import itertools

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, one of the two generators of the code.
GENERATOR = 0xAE3
LENGTH = 23


@functools.cache
def index_table() -> np.ndarray:
    """int16 per 23-bit value: the 12-bit message of the codeword nearest to it. Built once a process."""
    messages = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros_like(messages)
    for bit in range(12):  # carry-less product with the generator
        words ^= np.where(messages >> bit & 1, GENERATOR << bit, 0)
    table = np.full(1 << LENGTH, -1, dtype=np.int16)
    for weight in range(4):
        for bits in itertools.combinations(range(LENGTH), weight):
            table[words ^ sum(1 << b for b in bits)] = messages
    return table


def near_indices(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 1 + width): the index of each value, then of the value with each of its bits turned."""
    table = index_table()
    out = np.empty((len(values), 1 + width), dtype=np.int16)
    out[:, 0] = table[values]
    for b in range(width):
        out[:, 1 + b] = table[values ^ (1 << b)]
    return out
