"""Distinct word shingles of whole Arrow batches of texts, hashed to 64 bits by array operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a shingle.
WORDS = 5
U = np.uint64
#: Bytes of text that are worked on at a time, here and in a stretch of one text.
AT_ONCE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, the same for a letter's two cases, and which bytes are white space."""
    value = mix(np.arange(1, 257, dtype=U))
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return value, blank


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([[U(1)], np.full(n - 1, U(b))])) for b in (base, pow(base, -1, 1 << 64)))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text's begin (one more than there are
    texts). A-Z count as a-z. A word's hash is the sum of its bytes' numbers times powers of an odd base."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    offsets = offsets - low
    value, blank = _bytes()
    inside = ~blank[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = np.empty(len(at), U)
    first = 0
    while first < len(at):
        stop = max(first + 1, int(np.searchsorted(to, at[first] + AT_ONCE, side="right")))
        low, own = int(at[first]), data[at[first] : to[stop - 1]]
        powers, inverse = _powers(1 << max(AT_ONCE.bit_length(), (len(own) + 1).bit_length()))
        with np.errstate(over="ignore"):
            total = np.zeros(len(own) + 1, U)
            np.cumsum(value[own] * powers[: len(own)], out=total[1:])
            x, y = at[first:stop] - low, to[first:stop] - low
            hashes[first:stop] = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(U))
        first = stop
    return hashes, np.searchsorted(at, offsets)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in order, in slices of about AT_ONCE bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        yield texts.slice(first, stop - first)
        first = stop


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles. A text of fewer words has one of all its words; one
    without words, or null, has none."""
    return [own for part in slices(texts) for own in _sets(part, size)]


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    hashes, begin = words(texts)
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for k in range(1, size):
            left = max(0, len(rolled) - k)
            rolled[:left] = mix(rolled[:left] + U(k)) + hashes[len(hashes) - left :]
        rolled = mix(rolled)
        sets = []
        for low, high in zip(begin[:-1].tolist(), begin[1:].tolist()):
            n = high - low
            if n >= size:
                own = np.sort(rolled[low : high - size + 1])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif n:
                short = U(n)
                for h in hashes[low:high]:
                    short = mix(short + h)
                sets.append(np.array([short], U))
            else:
                sets.append(np.zeros(0, U))
    return sets
