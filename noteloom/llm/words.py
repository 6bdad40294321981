"""Hashes of words in UTF-8 bytes, in numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte (of A-Z and a-z alike); 0 for the bytes between words.
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUE[IS_SPACE] = 0
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_CHUNK = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE, _CHUNK), _powers(BASE_INVERSE, _CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def power(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2 ** 64."""
    up = _UP if base == BASE else _DOWN
    if not len(exponents) or int(exponents.max()) < _CHUNK:
        return up[exponents]
    step = np.multiply(up[-1], base)
    high = exponents // _CHUNK
    return up[exponents % _CHUNK] * _powers(step, int(high.max()) + 1)[high]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and each text's number of words."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    space = IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[0::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_VALUE[raw] * power(BASE, np.arange(len(raw))), out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * power(BASE_INVERSE, starts) + (stops - starts).astype(U64))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return hashes, np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
