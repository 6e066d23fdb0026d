"""Vector bin packing of token pieces.

A piece has three sizes: tokens, one segment, and loss-bearing tokens; a sequence has a limit
for each. Pieces are placed by the dot-product heuristic: a sequence is filled by the piece that
fits and has the largest weighted dot product of its sizes with the room left, until none fits;
the weight of a size is the share of all limits that the pieces demand of it. Where cutting is
allowed, the emptiest sequences are then cut up to fill the gaps of the others.

Packing goes on inside each input partition, over blocks of at most ``block`` pieces: nothing is
shuffled, a hot source is just more blocks, memory is bounded by a block, and a lost task is
made again from its input split. Each block ends in at most one ill-filled sequence (cutting
allowed), so padding falls with the size of a partition.

Defined results: a null or empty text is packed as its end id alone; repeated rows and repeated
or null ids are packed each on its own; an empty table gives no pieces; other columns are dropped.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment int"


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments, loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


#: Trailing signs that are encoded apart from their word.
SIGNS = b"#*$%&|<>.,;:!?"


class WordIds:
    """Ids by a vocabulary that drops white space: every word is encoded once and kept, so a text costs a lookup a word.

    ASCII white space never is part of a token there, and neither normalisation nor lower-casing looks across it.
    """

    def __init__(self, path: str, cache: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.old, self.cache = {}, {}, cache

    def _learn(self, missing: set[bytes]) -> None:
        if len(self.known) > self.cache:
            self.old, self.known = self.known, {}
        old, known, split, new = self.old, self.known, [], set()
        for w in missing:
            if w in old:
                known[w] = old[w]
                continue
            stem = w.rstrip(SIGNS)
            # A sign after an ASCII letter or digit begins a token of its own, so stem and signs are encoded apart.
            if 0 < len(stem) < len(w) and stem[-1:].isalnum() and b"<|" not in w:
                signs = w[len(stem) :]
                split.append((w, stem, signs))
                new.update(x for x in (stem, signs) if x not in known)
            else:
                new.add(w)
        words = list(new)
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)):
            known[w] = struct.pack(f"<{len(e)}I", *e.ids)
        for w, stem, signs in split:
            known[w] = known[stem] + known[signs]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        get, out, words = self.known.get, [], []
        missing: set[bytes] = set()
        for x in texts:
            # The vocabulary is lower case; only its special strings are not to be made by lowering.
            w = (x if b"<|" in x else x.lower()).split()
            ids = list(map(get, w))
            if None in ids:
                missing.update(a for a, b in zip(w, ids) if b is None)
            words.append(w)
            out.append(ids)
        if missing:
            self._learn(missing)
            get = self.known.get
            for k, (w, ids) in enumerate(zip(words, out)):
                if None in ids:
                    out[k] = [get(a) if b is None else b for a, b in zip(w, ids)]
        return [b"".join(ids) for ids in out]


_encoders: dict[tuple[str, str], WordIds] = {}


def _of_worker(path: str, query: str) -> WordIds:
    if (path, query) not in _encoders:
        _encoders.clear()
        _encoders[path, query] = WordIds(path)
    return _encoders[path, query]


def word_ids(path: str) -> Callable[[], WordIds]:
    """An encoder for pack(), one for each worker process: a task finds the words that the query's tasks before it have encoded.

    The next query begins anew, so a worker holds the words of one.
    """
    return partial(_of_worker, path, uuid.uuid4().hex)  # goes to workers by name, so they keep what it makes


def dot_product_bins(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Rows of sizes (pieces x resources) dealt into bins under limits; every row must fit an empty bin."""
    share = sizes / limits
    order = np.argsort(-share.sum(1), kind="stable")
    share = share[order]
    weight = share.sum(0) / max(share.sum(), 1e-12)
    weighted = share * weight
    alive = np.ones(len(share), bool)
    bins: list[list[int]] = []
    first = 0
    while first < len(share):
        if not alive[first]:
            first += 1
            continue
        room, chosen, pick = np.ones(sizes.shape[1]), [], first
        # Resources are used up as the bin fills, so what does not fit now never will: candidates only go.
        left = np.flatnonzero(alive[first:]) + first
        while True:
            chosen.append(int(order[pick]))
            alive[pick] = False
            room = room - share[pick]
            left = left[alive[left]]
            left = left[(share[left] <= room + 1e-9).all(1)]
            if not len(left):
                break
            pick = int(left[np.argmax(weighted[left] @ room)])
        bins.append(chosen)
    return bins


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: bytes
    doc_tokens: int
    loss_from: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self) - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens, self.loss_from),
            Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens, self.loss_from),
        )


def pack_block(pieces: list[Piece], limits: Limits, cut: bool) -> list[list[Piece]]:
    """Sequences of one block."""
    if not pieces:
        return []
    sizes = np.array([[len(p), 1, p.loss] for p in pieces], float)
    top = np.array([limits.tokens, limits.segments, limits.loss], float)
    if (over := (sizes > top).any(1)).any():
        raise ValueError(f"{int(over.sum())} pieces are larger than a sequence may be")
    packed = [[pieces[i] for i in b] for b in dot_product_bins(sizes, top)]
    if not cut:
        return packed
    packed.sort(key=lambda b: -sum(map(len, b)))
    filled: list[list[Piece]] = []
    i, donor = 0, []
    j = len(packed)
    while i < j:
        target = packed[i]
        i += 1
        gap, loss, room = limits.tokens - sum(map(len, target)), limits.loss - sum(p.loss for p in target), limits.segments - len(target)
        while gap > 0 and loss > 0 and room > 0:
            if not donor:
                if i >= j:
                    break
                j -= 1
                donor = packed[j]
            p = donor.pop()
            n = min(gap, len(p))
            if p.loss > loss:
                n = min(n, max(0, p.loss_from - p.start) + loss)
            if n < len(p):
                p, rest = p.cut(n)
                donor.append(rest)
            target.append(p)
            gap, loss, room = gap - n, loss - p.loss, room - 1
        filled.append(target)
    if donor:
        filled.append(donor)
    return filled


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[bytes]], list[bytes]]],
    limits: Limits = Limits(),
    end_id: int | None = 1,
    cut: bool = True,
    block: int = 1024,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of docs (doc_id, text, and if it has it loss_from: the first loss-bearing token) and the sequence of each.

    encoder() is called by each task; what it gives makes texts into ids, as little-endian 32-bit numbers.
    cut: pieces may be cut anywhere; without it only documents longer than a sequence are.
    with_ids: a binary column ``ids`` holds the ids themselves.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    full = min(limits.tokens, limits.loss)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    loss_from = F.coalesce(F.col("loss_from"), F.lit(0)) if "loss_from" in docs.columns else F.lit(0)
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), loss_from.cast("long").alias("loss_from"))
    schema = OUT + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        sequence = TaskContext.get().partitionId() << 40
        ends: list[list[Piece]] = []  # sequences to give out
        waiting: list[Piece] = []

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(9 + with_ids)]
            for pieces in ends:
                offset = 0
                for k, p in enumerate(pieces):
                    row = [p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, offset, p.loss, k]
                    for c, v in zip(cols, row + [p.ids] * with_ids):
                        c.append(v)
                    offset += len(p)
                sequence += 1
            ends.clear()
            kinds = [pa.int64()] * 8 + [pa.int32()] + [pa.binary()] * with_ids
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for b in batches:
            texts = b.column(1).to_pylist()
            encoded = (ids for i in range(0, len(texts), 256) for ids in encode(texts[i : i + 256]))
            for doc, ids, since in zip(b.column(0).to_pylist(), encoded, b.column(2).to_pylist()):
                ids += end
                rest = Piece(doc, 0, ids, len(ids) // 4, since)
                while len(rest) >= full:
                    head, rest = rest.cut(full)
                    ends.append([head])
                if len(rest):
                    waiting.append(rest)
                if len(waiting) >= block:
                    ends.extend(pack_block(waiting, limits, cut))
                    waiting = []
                if len(ends) >= block:
                    yield rows()
        ends.extend(pack_block(waiting, limits, cut))
        if ends:
            yield rows()

    return src.mapInArrow(run, schema)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; every token bears loss, so that limit equals the first."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_ids(path))
