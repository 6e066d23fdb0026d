"""Merkle trees over hexadecimal SHA-256 hashes; an odd node is promoted as it is."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T


def parent(left: str, right: str) -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def _up(level: list[str]) -> list[str]:
    return [parent(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]


def root(hashes: list[str]) -> str:
    """Of no hashes: the hash of nothing."""
    level = list(hashes) or [hashlib.sha256(b"").hexdigest()]
    while len(level) > 1:
        level = _up(level)
    return level[0]


def proof(hashes: list[str], index: int) -> list[tuple[str, bool]]:
    """(sibling, whether it stands on the left) from the leaf up; none for an index that isn't there."""
    if not 0 <= index < len(hashes):
        return []
    steps, level = [], list(hashes)
    while len(level) > 1:
        beside = index ^ 1
        if beside < len(level):
            steps.append((level[beside], beside < index))
        level, index = _up(level), index // 2
    return steps


def verify(leaf: str, steps: list[tuple[str, bool]], expected: str) -> bool:
    for sibling, on_left in steps:
        leaf = parent(sibling, leaf) if on_left else parent(leaf, sibling)
    return leaf == expected


@F.pandas_udf(T.StringType())
def merkle_root(hashes):
    """Of an array column of chunk hashes in order."""
    return hashes.map(lambda h: None if h is None else root(list(h)))
