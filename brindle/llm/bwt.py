"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

All in numpy. A shard is a circular text: its strings, each closed by a byte that UTF-8 never has. Its
suffixes are sorted once, by prefix doubling that only looks at what is still tied. Shards are then
merged without sorting their suffixes anew (Holt and McMillan, 2014): the interleave, at first by the
first symbol, is refined with each step by one more symbol, as the order of cX among those that begin
with c is the order of X. A symbol here is eight bytes, so a step lengthens the known prefix by
eight bytes and 200 bytes take 24 steps. Only open blocks are refined: those of equal prefixes that hold
suffixes of several shards and don't reach the end of a string yet. A block of one shard keeps its shard's order.

What lies behind the end of a string tells nothing of its substrings: suffixes that agree up to it stay tied.
Sorts are of numbers that carry their own place in the low bits, as numpy sorts values far faster than indices.
"""

from __future__ import annotations

import numpy as np

STEP, CLOSE = 8, 0xFF


def _kind(n: int) -> type:
    """Of numbers up to n: half as wide where that holds them, as arrays of them are most of the memory."""
    return np.int32 if n < 1 << 31 else np.int64


def _order(keys: np.ndarray, limit: int) -> np.ndarray:
    """The stable order of keys, which are not negative and below limit."""
    bits = len(keys).bit_length()
    if limit << bits > 1 << 63:
        return np.argsort(keys, kind="stable")
    held = (keys.astype(np.int64) << bits) | np.arange(len(keys))
    held.sort()
    return held & ((1 << bits) - 1)


def _starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: where the run of equals that each belongs to begins."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(keys), dtype=_kind(len(keys))), 0))


class ShardBwt:
    """Suffixes of one shard, sorted by their first ``depth`` bytes (a multiple of 8) or up to the end of their string."""

    def __init__(self, strings: list[bytes], depth: int):
        text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
        n = self.n = len(text)
        kind = _kind(n)
        around = np.concatenate([text, np.resize(text, STEP)])
        packed = np.zeros(n, np.uint64)
        for j in range(STEP):
            packed = (packed << np.uint64(8)) | around[j : j + n]
        self.packed = packed  # the eight bytes from each position on
        sizes = np.array([len(s) + 1 for s in strings])
        self.left = np.repeat(np.cumsum(sizes).astype(kind), sizes) - np.arange(n, dtype=kind)  # bytes to the end of the string, CLOSE included
        sa = np.argsort(packed).astype(kind)  # what is tied is told apart below, or counts as equal
        rank = np.empty(n, kind)
        self.group = starts = _starts(packed[sa])
        rank[sa] = starts
        slots = self._tied(starts, np.arange(n, dtype=kind))
        h = STEP
        while h < depth:
            slots = slots[self.left[sa[slots]] > h]  # equal prefixes end alike, so all of a run or none
            if not len(slots):
                break
            more = min(h, depth - h)
            i = sa[slots]
            key = rank[i].astype(np.int64) * n + rank[i + more]
            o = _order(key, n * n)
            i, key = i[o], key[o]
            sa[slots] = i
            starts = slots[_starts(key)]
            rank[i] = self.group[slots] = starts
            slots = self._tied(starts, slots)
            h += more
        self.sa, self.rank = sa, rank
        rank[sa] = np.arange(n, dtype=kind)

    @staticmethod
    def _tied(starts: np.ndarray, slots: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], starts[1:] != starts[:-1], [True]])
        return slots[~(new[1:] & new[:-1])]


def merged_groups(shards: list[ShardBwt], depth: int) -> list[np.ndarray]:
    """For each shard, a number for every text position whose string has depth bytes more: equal where these are equal, in whatever shard."""
    total = sum(s.n for s in shards)
    kind = _kind(total)
    base = np.cumsum([0, *(s.n for s in shards)]).astype(kind)
    shard = np.concatenate([np.full(s.n, k, np.int16) for k, s in enumerate(shards)])
    first = np.concatenate([s.packed[s.sa] for s in shards])
    left = np.concatenate([s.left[s.sa] for s in shards])
    # Where the suffix stands that begins with the transform (the eight bytes before each suffix).
    step_back = np.concatenate([s.rank[s.sa - STEP] + base[k] for k, s in enumerate(shards)])

    rows = np.argsort(first, kind="stable").astype(kind)  # sorted runs, so this merges
    every = np.arange(total, dtype=kind)
    place = np.empty(total, kind)
    place[rows] = every
    symbol = np.empty(total, kind)  # a symbol is named by where those that begin with it begin
    starts = _starts(first[rows])
    symbol[rows] = starts
    begins = starts == every
    del first
    several = np.zeros(total, bool)  # places in blocks of several shards
    open_rows = np.zeros(total, bool)

    def judge(at: np.ndarray, new: np.ndarray, known: int) -> None:
        """Notes which of the places at, in blocks that new begins and of which known bytes are equal, lie in blocks of several shards and in open ones."""
        r = rows[at]
        s, head = shard[r], np.flatnonzero(new)
        mixed = np.minimum.reduceat(s, head) != np.maximum.reduceat(s, head)
        sizes = np.diff(head, append=len(at))
        several[at] = np.repeat(mixed, sizes)
        open_rows[r] = np.repeat(mixed & (left[r[head]] > known), sizes)

    at, block = every, np.cumsum(begins, dtype=kind)
    judge(at, begins, STEP)
    for known in range(2 * STEP, depth + 1, STEP):
        # Of open blocks all that they are refined by lies in blocks that the last step refined.
        q = step_back[rows[at]]
        go = open_rows[q]
        if not go.any():
            break
        q, block = q[go], block[go]
        c = symbol[q]
        o = _order(c, total)
        c, q, block = c[o], q[o], block[o]
        at = np.sort(place[q])
        rows[at] = q
        place[q] = at
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])])
        begins[at[new]] = True
        judge(at, new, known)
        block = np.cumsum(new, dtype=kind)
    # several: blocks that hold suffixes of several shards; in others, the shard's own groups count.
    own = np.concatenate([s.group for s in shards])[rows]
    same_own = np.concatenate([[False], (shard[rows][1:] == shard[rows][:-1]) & (own[1:] == own[:-1])])
    same = ~begins & (several | same_own)
    number = np.empty(total, kind)
    number[rows] = np.cumsum(~same)
    return [number[base[k] + s.rank] for k, s in enumerate(shards)]


def repeated_starts(strings: list[bytes], weights: list[int], depth: int = 200, shards: int = 4) -> list[np.ndarray]:
    """For each string, a boolean for each start of a depth-byte substring: does it stand anywhere else?

    weights: how often each string occurs; strings must be distinct.
    """
    shards = max(1, min(shards, len(strings)))
    # Neighbours share a shard: strings that come sorted by what they have in common then leave the merge few mixed blocks.
    cuts = [len(strings) * k // shards for k in range(shards + 1)]
    parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]
    built = [ShardBwt([strings[i] for i in p], depth) for p in parts]
    numbers = merged_groups(built, depth)
    found, weight, where = [], [], []
    for p, number in zip(parts, numbers):
        at = 0
        for i in p:
            n = max(0, len(strings[i]) - depth + 1)
            found.append(number[at : at + n])
            weight.append(np.full(n, weights[i]))
            where.append(i)
            at += len(strings[i]) + 1
    flat = np.concatenate(found)
    times = np.bincount(flat, weights=np.concatenate(weight)) if len(flat) else np.empty(0)
    out: list[np.ndarray] = [np.empty(0, bool)] * len(strings)
    for i, numbers_of in zip(where, found):
        out[i] = times[numbers_of] > 1 if len(numbers_of) else np.empty(0, bool)
    return out
