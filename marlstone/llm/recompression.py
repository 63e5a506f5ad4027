"""Recompression of word sequences: rounds that name runs of a symbol and then pairs of symbols.

In a round every maximal run of one symbol becomes one symbol, and then every adjacent pair (x, y)
with x in the left class and y in the right class becomes one; a bit of a symbol's name says its
class, so no two pairs overlap and no position decides. Names are 64-bit hashes of what they stand
for. So all machines give equal content the same name without exchanging dictionaries, and a round
needs no shuffle.

Each symbol carries its context: the words that its extent and name depend on. Wherever the words
of a context recur, the symbol recurs with the same extent, name and context. That is what makes
symbols inside a repeat equal in all places, and it is tracked exactly, not estimated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so each has an inverse mod 2^64
NONE = np.int64(1) << 40


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x = x ^ (x >> U(33))
    x = x * _M2
    return x ^ (x >> U(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Spans:
    """128-bit names of any span of a word sequence from prefix sums of hash * base^position."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, hashes: np.ndarray):
        self.sums = []
        for k, base in enumerate(_BASES):
            c = np.zeros(len(hashes) + 1, dtype=np.uint64)
            w = hashes if k == 0 else mix(hashes + U(k))
            np.cumsum(w * self._power(base, len(hashes))[: len(hashes)], out=c[1:])
            self.sums.append(c)

    @classmethod
    def _power(cls, base: int, n: int) -> np.ndarray:
        got = cls._powers.get(base)
        if got is None or len(got) <= n:
            got = np.full(max(n + 1, 1 << 18), base, dtype=np.uint64)
            got[0] = 1
            got = np.cumprod(got)
            cls._powers[base] = got
        return got

    def name(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        c = self.sums[which]
        inverse = pow(_BASES[which], -1, 1 << 64)
        down = self._power(inverse, len(c))
        return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Symbols:
    name: np.ndarray
    start: np.ndarray  # the words it stands for
    end: np.ndarray
    low: np.ndarray  # the words it depends on
    high: np.ndarray
    text: np.ndarray  # which sequence it is in
    level: np.ndarray  # the step that formed it, 0 for words

    def take(self, keep) -> Symbols:
        return Symbols(*(x[keep] for x in (self.name, self.start, self.end, self.low, self.high, self.text, self.level)))


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a symbol follows one of the same sequence; context starts to the left, ends to the right."""
    n = len(s.name)
    joined = np.zeros(n, dtype=bool)
    joined[1:] = s.text[1:] == s.text[:-1]
    left = np.full(n, -NONE)
    left[1:] = np.where(joined[1:], s.low[:-1], -NONE)
    right = np.full(n, NONE)
    right[:-1] = np.where(joined[1:], s.high[1:], NONE)
    return joined, left, right


def name_runs(s: Symbols, step: int) -> Symbols:
    if not len(s.name):
        return s
    joined, left, right = _neighbours(s)
    head = np.ones(len(s.name), dtype=bool)
    head[1:] = ~(joined[1:] & (s.name[1:] == s.name[:-1]))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(s.name)) - 1
    size = (last - first + 1).astype(np.uint64)
    name = np.where(size == 1, s.name[first], mix(s.name[first] ^ mix(size + U(0x51))))
    level = np.where(size == 1, s.level[first], step)
    return Symbols(name, s.start[first], s.end[last], np.minimum(s.low[first], left[first]), np.maximum(s.high[last], right[last]), s.text[first], level)


def name_pairs(s: Symbols, step: int) -> Symbols:
    if not len(s.name):
        return s
    joined, left, right = _neighbours(s)
    is_left = (mix(s.name + U(step * 2 + 1)) & U(1)).astype(bool)
    opens = np.zeros(len(s.name), dtype=bool)
    opens[:-1] = is_left[:-1] & ~is_left[1:] & joined[1:]
    closes = np.zeros(len(s.name), dtype=bool)
    closes[1:] = opens[:-1]
    nxt = np.minimum(np.arange(len(s.name)) + 1, len(s.name) - 1)
    name = np.where(opens, mix(mix(s.name + U(0x9D)) ^ (s.name[nxt] * _M1)), s.name)
    # A pair is known from its two names; a single one from the class of the neighbour it could join.
    low = np.where(opens | is_left, s.low, np.minimum(s.low, left))
    high = np.where(opens, np.maximum(s.high, s.high[nxt]), np.where(is_left, np.maximum(s.high, right), s.high))
    low = np.where(opens, np.minimum(s.low, s.low[nxt]), low)
    end = np.where(opens, s.end[nxt], s.end)
    return Symbols(name, s.start, end, low, high, s.text, np.where(opens, step, s.level)).take(~closes)


def recompress(hashes: np.ndarray, text: np.ndarray, rounds: int) -> Iterator[Symbols]:
    """The symbols that each step of each round forms of concatenated sequences, runs and then pairs,
    with the contexts that they depend on then; text tells the sequences apart."""
    at = np.arange(len(hashes), dtype=np.int64)
    s = Symbols(mix(hashes), at, at + 1, at, at + 1, text, np.zeros(len(hashes), dtype=np.int64))
    for step in range(1, 2 * rounds + 1):
        s = (name_runs if step % 2 else name_pairs)(s, step)
        yield s.take(s.level == step)
