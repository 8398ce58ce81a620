"""Words of many texts at once, as positions in a byte buffer, and their hashes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: ASCII white space, which separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_STEP, _MIX = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9
#: Masks of the first bytes of a lane.
_FIRST = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: buffer, first and last + 1 byte of each, and each text's number of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The number of words before each text's."""
        return np.cumsum(self.count) - self.count


def split(texts: list[bytes]) -> Words:
    """Words are what ASCII white space separates; they never reach across texts."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(start, bounds)
    return Words(data, start, end, np.diff(upto, prepend=0))


def hashes(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes in lanes of 8; equal words have equal hashes."""
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))  # the eight bytes from each byte on
    length = words.end - words.start
    out = np.full(len(length), np.uint64(seed & (2**64 - 1))) + length.astype(np.uint64) * np.uint64(_STEP)
    out = mixed(out)
    live, at, left = np.arange(len(length)), words.start, length
    while len(live):
        lane = lanes[at] & _FIRST[np.minimum(left, 8)]  # bytes beyond the word's end are masked
        out[live] = mixed((out[live] ^ lane) * np.uint64(_STEP))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def grams(word_hash: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n words; fewer than n words give none."""
    size = len(word_hash) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(((seed * 2 + 1) * _STEP | 1) & (2**64 - 1))
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * base + word_hash[i : i + size]
    return mixed(out)
