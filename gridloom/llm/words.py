"""Words and word shingles of a block of texts as 64-bit hashes, all in numpy.

A word's hash is a polynomial of its bytes, taken from prefix sums modulo 2**64
and then mixed; equal words have equal hashes in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from gridloom.llm.arrow import buffers

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Digits, lower-case letters and every byte of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: All but blank and the control characters 9 to 13.
GRAPHIC = np.ones(256, bool)
GRAPHIC[[32, *range(9, 14)]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, base: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[which] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _powers[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h


@dataclass
class Words:
    """Words of a block: bytes (lower case), where each begins and ends, its row, its hash; and each row's first word."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def word(self, k: int) -> str:
        return self.data[self.begin[k] : self.end[k]].tobytes().decode()


def words(texts: pa.Array, inside: np.ndarray = ALNUM) -> Words:
    raw, at = buffers(texts)
    data = raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))  # capitals of ASCII become small
    flags = np.zeros(len(data) + 2, bool)
    np.take(inside, data, out=flags[1:-1])
    here, edge = flags[1:-1], np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(here & (~flags[:-2] | edge[:-1]))
    end = np.flatnonzero(here & (~flags[2:] | edge[1:])) + 1
    first = np.searchsorted(begin, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(0, BASE, len(data)), out=sums[1:])
        h = (sums[end] - sums[begin]) * _power(1, INVERSE, len(data) + 1)[begin]
        h += (end - begin).astype(np.uint64) * STEP
    return Words(data, begin, end, row, mix(h), first)


def hash_of(word: str) -> int:
    return int(words(pa.array([word], pa.large_string()), np.ones(256, bool)).hash[0])


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all runs of ``size`` words; a row of fewer words has its whole sequence as one, a row without words none."""
    count = np.diff(w.first)
    own = np.maximum(count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), own)
    starts = np.cumsum(own) - own
    place = np.arange(own.sum()) + np.repeat(w.first[:-1] - starts, own)
    out, h = np.zeros(len(row), np.uint64), np.zeros(len(w.hash), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, size + 1):  # h: of the runs of k words that begin at each word
            h = h[: max(len(w.hash) - k + 1, 0)] * STEP
            h += w.hash[k - 1 :]
            h = mix(h)
            whole = np.flatnonzero(count == k) if k < size else []
            if len(whole):
                out[starts[whole]] = h[w.first[whole]]
    long_ = count >= size
    if long_.all():
        return row, h[place]
    of = long_[row]
    out[of] = h[place[of]]
    return row, out
