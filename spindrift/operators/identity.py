"""Operation identities: a canonical fingerprint of what an operation means to do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass


class IdentityError(ValueError):
    pass


def canonical(value) -> bytes:
    """Type-tagged, length-delimited bytes: no two different values share an encoding."""
    if value is None:
        return b"n"
    if isinstance(value, bool):
        return b"b1" if value else b"b0"
    if isinstance(value, int):
        tag, body = b"i", str(value).encode()
    elif isinstance(value, str):
        tag, body = b"s", value.encode()
    elif isinstance(value, bytes):
        tag, body = b"y", value
    elif isinstance(value, dict):
        tag, body = b"d", b"".join(canonical(k) + canonical(value[k]) for k in sorted(value))
    elif isinstance(value, list | tuple):
        tag, body = b"l", b"".join(map(canonical, value))
    else:
        raise IdentityError(f"no canonical form for {type(value).__name__}")
    return tag + len(body).to_bytes(8, "big") + body


@dataclass(frozen=True)
class OperationIdentity:
    domain: str
    fingerprint: bytes
    version: int = 1

    @property
    def key(self) -> str:
        return f"spindrift/{self.domain}/v{self.version}/{self.fingerprint.hex()}"

    @staticmethod
    def of(domain: str, value) -> OperationIdentity:
        return OperationIdentity(domain, hashlib.sha256(canonical([domain, 1, value])).digest())


@dataclass(frozen=True, order=True)
class OffsetRange:
    """Consumed offsets of one source partition, both ends included."""

    topic: str
    partition: int
    first: int
    last: int


def ingest_identity(hypertable: int, ranges: Iterable[OffsetRange], transform: str = "") -> OperationIdentity:
    """Identity of the ingest of these offset ranges, in whatever order they are given."""
    found = sorted(ranges)
    if not found:
        raise IdentityError("an ingest covers at least one offset range")
    for r in found:
        if r.first > r.last:
            raise IdentityError(f"inverted range {r}")
    for a, b in zip(found, found[1:], strict=False):
        if (a.topic, a.partition) == (b.topic, b.partition) and b.first <= a.last:
            raise IdentityError(f"ranges overlap: {a} and {b}")
    return OperationIdentity.of("ingest", [hypertable, [[r.topic, r.partition, r.first, r.last] for r in found], transform])


def _inputs(parts: Sequence[int]) -> list[int]:
    if not parts:
        raise IdentityError("no input parts")
    if len(set(parts)) != len(parts):
        raise IdentityError("an input part is named twice")
    return sorted(parts)


def compaction_identity(hypertable: int, parts: Sequence[int], level: int) -> OperationIdentity:
    return OperationIdentity.of("compaction", [hypertable, _inputs(parts), level])


def delete_key_identity(hypertable: int, key: int, parts: Sequence[int]) -> OperationIdentity:
    return OperationIdentity.of("delete-key", [hypertable, key, _inputs(parts)])
