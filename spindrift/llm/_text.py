"""Vectorised words and word shingles over Arrow string buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased.  Its 64-bit hash
is a polynomial over per-byte random values, taken for all words of a block at once from running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 19  # text of one numpy pass; a single longer text makes a block of its own
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix((np.arange(256, dtype=U) + U(1)) * U(0xD1342543DE82EF95))[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    hashes: np.ndarray  # of each word of the block
    first: np.ndarray  # text k has the words first[k]:first[k + 1]
    start: np.ndarray  # byte offsets in `data`
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # text k has the bytes offsets[k]:offsets[k + 1]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK_BYTES of text."""
    size = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    ends, low = np.cumsum(size), 0
    while low < len(size):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
        yield low, high
        low = high


def words(texts: pa.Array) -> Words:
    """Words of a block of texts; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    space = np.concatenate(([True], _SPACE[data], [True]))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = ~space[1:-1]
    start = np.flatnonzero(inside & (space[:-2] | cut[:-1]))
    end = np.flatnonzero(inside & (space[2:] | cut[1:])) + 1
    up, down = _power(n + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_VALUE[data] * up[:n], dtype=U)))
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return Words(hashes, np.searchsorted(start, offsets), start, end, data, offsets)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-word shingle at each word, and whether all its words are in one text."""
    total = len(w.hashes)
    out = np.zeros(total, U)
    for k in range(n):
        out[: max(total - k, 0)] += mix(w.hashes[k:] + U(k * 2654435769 + 1)) * U(2 * k + 3)
    whole = np.zeros(total, bool)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    whole[:] = np.arange(total) + n <= w.first[1:][text] if total else False
    return mix(out), whole


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingle hashes; fewer words: the sequence as one."""
    for low, high in blocks(texts):
        w = words(texts.slice(low, high - low))
        s, _ = shingles(w, n)
        for k in range(high - low):
            a, b = w.first[k], w.first[k + 1]
            if b - a >= n:
                yield np.unique(s[a : b - n + 1])
            elif b > a:
                x = U(b - a)
                for h in w.hashes[a:b]:
                    x = mix(np.array([x ^ h], U))[0]
                yield np.array([x], U)
            else:
                yield np.zeros(0, U)
