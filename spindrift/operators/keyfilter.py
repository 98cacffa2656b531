"""Which packing keys a part holds: the keys themselves if they are few, else a Bloom filter of them.

A filter is sized from the number of keys for `ERROR` false positives.  It begins with the number of probes;
the rest are the bits.  Only proof of absence prunes: whatever cannot be decided keeps the part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

SET_LIMIT = 512  # keys kept as they are
BLOOM_LIMIT = 1 << 15  # keys of a filter: at most 40 KB
ERROR = 0.01


def _hashes(key: int, bits: int, probes: int) -> list[int]:
    digest = hashlib.blake2b(key.to_bytes(8, "little", signed=True), digest_size=16).digest()
    start, step = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
    return [(start + k * step) % bits for k in range(probes)]


def key_set(keys: Iterable[int]) -> list[int] | None:
    """Sorted distinct keys; None (undecidable) for one key, whose range is exact, or over the limit."""
    found = sorted(set(keys))
    return found if 1 < len(found) <= SET_LIMIT else None


def set_excludes(keys: list[int] | None, key: int) -> bool:
    return keys is not None and key not in keys


def bloom(keys: Iterable[int]) -> bytes | None:
    """A filter of the keys; None if the keys themselves are kept, or are too many."""
    found = set(keys)
    if not SET_LIMIT < len(found) <= BLOOM_LIMIT:
        return None
    size = math.ceil(-len(found) * math.log(ERROR) / math.log(2) ** 2 / 8)
    probes = max(1, round(size * 8 / len(found) * math.log(2)))
    body = bytearray(size)
    for key in found:
        for bit in _hashes(key, size * 8, probes):
            body[bit // 8] |= 1 << bit % 8
    return bytes([probes]) + bytes(body)


def bloom_may_hold(filter: bytes | None, key: int) -> bool:
    """False only if the filter shows that the key is absent."""
    if not filter or len(filter) < 2 or not 0 < filter[0] < 64:
        return True
    return all(filter[1 + bit // 8] >> bit % 8 & 1 for bit in _hashes(key, (len(filter) - 1) * 8, filter[0]))
