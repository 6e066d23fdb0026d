"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_components(docs):
    """{doc_id: smallest id reachable} of [(doc_id, text)] with unique ids."""
    s = {i: shingles(t) for i, t in docs}
    owners = collections.defaultdict(list)
    for i in sorted(s):
        for g in s[i]:
            owners[g].append(i)
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = collections.Counter((a, b) for o in owners.values() for k, a in enumerate(o) for b in o[k + 1 :])
    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(s[a]) + len(s[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def line_keys(text):
    return [x.strip(WS).translate(LOWER) for x in (text or "").split("\n")]


def drop_lines(docs, min_docs=3, min_chars=20):
    """{doc_id: (lines, kept lines)} of [(doc_id, text)] with unique ids."""
    held = collections.defaultdict(set)
    for i, t in docs:
        for k in line_keys(t):
            if len(k) >= min_chars:
                held[k].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, line_keys(t)) if not (len(k) >= min_chars and len(held[k]) >= min_docs and max(held[k]) != i)]
        out[i] = lines, kept
    return out


def cut_repeats(docs, length=200):
    """{doc_id: (bytes, removed, spans, kept)} of [(doc_id, text)]."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    times = collections.Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        out[i] = len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)
    return out


def base_failed(text):
    w = words(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    return len(w) < 10 or 100 * len(covered) > 20 * len(w), len(covered)


def leaks(text, items):
    """Ids of items like a window of their length."""
    w = [x.lower() for x in words(text)]
    out = set()
    for item, t in items:
        v = [x.lower() for x in words(t)]
        k = min(5, len(v))
        if not v or not w:
            continue
        own = collections.Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
        have = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        if 100 * sum(n for g, n in own.items() if g in have) < 75 * sum(own.values()):
            continue
        for s in range(max(1, len(w) - len(v) + 1)):
            part = w[s : s + len(v)]
            c = collections.Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
            same = sum((own & c).values())
            if same and 100 * same >= 75 * (sum(own.values()) + sum(c.values()) - same):
                out.add(item)
    return out


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
