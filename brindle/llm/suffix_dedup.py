"""Exact substring deduplication: bytes covered by a long string that also starts elsewhere go.

Suffixes are dealt out by minimizers, so that no task needs all of them. The minimizer of a window of
``length`` bytes is the smallest hash of the 40-byte strings in it; equal windows have equal minimizers.
Consecutive windows with one minimizer form a region. Steps:

1. every task hashes its texts into regions (minimizer, 64 bits of the content, place); texts are not shuffled;
2. regions whose minimizer stands at one place can't hold a repeat and go; of the others, equal regions are
   one class with a multiplicity, counted in each task before the shuffle;
3. the bytes of one region of each class are fetched and dealt by minimizer; in each task they are cut
   into shards whose Burrows-Wheeler transforms are merged (bwt.py), and the groups of equal
   ``length``-byte prefixes give, with the multiplicities, the windows that are repeated;
4. those go back to all regions of the class, and the bytes they cover are cut out of the documents.

A minimizer with more than ``hot`` different regions (a passage in very many documents, each with its own
surroundings) is dealt on: its regions are cut into runs of a few windows and those are dealt by the
bytes that all windows of a run share, so the parts that only one document has part company.

Defined results: a null or empty text has no bytes and loses none; a repeated row is a copy like any
other; null and repeated ids are fine, as rows are joined by id and text; an empty table gives an
empty one; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bwt import repeated_starts
from brindle.llm.common import join_hot, materialize, row_key, salts
from brindle.llm.shingles import _stream, mix


@dataclass(frozen=True)
class Plan:
    length: int = 200
    gram: int = 40
    #: Windows of a region at most.
    most: int = 512
    #: Bytes whose transforms are merged at a time, if one minimizer's regions aren't more.
    chunk: int = 2_000_000
    #: Regions of a minimizer beyond which it is dealt on, and windows of a run then.
    hot: int = 2000
    run: int = 8


_VALUES = _stream(21, 256)
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _tables[i] = np.multiply.accumulate(steps)
    return [t[:n] for t in _tables]


def _slide(x: np.ndarray, w: int, reduce: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of each w neighbours, from those of the heads and tails of blocks of w."""
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, w)
    heads = reduce.accumulate(blocks, 1).ravel()
    tails = reduce.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return reduce(tails[:m], heads[w - 1 : w - 1 + m])


def gram_hashes(text: bytes, k: int) -> np.ndarray:
    """Of the k-byte strings at each start; the text has k bytes at least."""
    n = len(text)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[np.frombuffer(text, np.uint8)] * up)])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def regions(text: bytes, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and minimizers of the regions of a text, and whether the text has that minimizer at several places."""
    if len(text) < plan.length:
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(bool)
    h, w = gram_hashes(text, plan.gram), plan.length - plan.gram + 1
    m = _slide(h, w, np.minimum, np.iinfo(np.uint64).max)
    start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    count = np.diff(start, append=len(m))
    # A place is a minimizer if it is the smallest of one of the windows that it lies in.
    around = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)])
    values, times = np.unique(h[_slide(around, w, np.maximum, 0) == h], return_counts=True)
    if (count > plan.most).any():
        start = np.concatenate([np.arange(s, s + c, plan.most) for s, c in zip(start, count)])
        count = np.diff(start, append=len(m))
    mini = m[start]
    return start, count, mini.view(np.int64), np.isin(mini, values[times > 1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("_row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _batch(**cols):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict(cols)


def all_regions(docs: DataFrame, plan: Plan) -> DataFrame:
    """_row, start, count, mini, ties, content of every region."""
    import pyarrow as pa
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest
        for b in batches:
            sizes, starts, counts, minis, ties, hashes = [], [], [], [], [], []
            for x in b.column(1):
                text = x.as_buffer().to_pybytes()
                s, c, m, t = regions(text, plan)
                sizes.append(len(s))
                if len(s):
                    ends = (s + c + plan.length - 1).tolist()
                    hashes.append(np.frombuffer(b"".join(digest(text[i:j]) for i, j in zip(s.tolist(), ends)), ">i8"))
                    starts.append(s)
                    counts.append(c)
                    minis.append(m)
                    ties.append(t)
            if starts:
                yield _batch(
                    _row=b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                    start=pa.array(np.concatenate(starts).astype(np.int32)),
                    count=pa.array(np.concatenate(counts).astype(np.int32)),
                    mini=pa.array(np.concatenate(minis), pa.int64()),
                    ties=pa.array(np.concatenate(ties)),
                    content=pa.array(np.concatenate(hashes).astype(np.int64)),
                )

    return _texts(docs).mapInArrow(run, "_row struct<a:long,b:long>, start int, count int, mini long, ties boolean, content long")


def _runs(text: bytes, mini: int, plan: Plan) -> Iterator[tuple[int, int, int]]:
    """(key, first, last window) of the runs of a region whose minimizer is hot.

    A window's run is told by its distance from the first place of the minimizer in it, and the key by
    the bytes that windows with these distances share; both are parts of the window, so equal windows
    have equal keys.
    """
    h = gram_hashes(text, plan.gram)
    places = np.flatnonzero(h == np.array([mini], np.int64).view(np.uint64)[0])
    n = len(text) - plan.length + 1
    first = places[np.searchsorted(places, np.arange(n))]
    turn = (first - np.arange(n)) // plan.run
    cuts = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (first[1:] != first[:-1])]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n]):
        lo = int(first[a] - turn[a] * plan.run)
        yield _hash(text[lo : lo - plan.run + 1 + plan.length], mini), a, b - 1


def _hash(x: bytes, seed: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


PIECE = "key long, content long, mini long, region long, first int, times long, hot boolean, bytes binary"


def _pieces(docs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """PIECE rows of classes (mini, content, times, hot, _row, start, count): the bytes of one region of each.

    Those of hot minimizers in runs, each with a key and content of its own. Both kinds come from one shuffle of the texts.
    """
    import pyarrow as pa

    entry = F.struct("mini", "content", "times", "hot", "start", "count")
    want = materialize(classes.groupBy("_row").agg(F.collect_list(entry).alias("want")), "want")
    src = _texts(docs).join(want, "_row").select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for x, entries in zip(b.column(0), b.column(1).to_pylist()):
                text = x.as_buffer().to_pybytes()
                for e in entries:
                    hot = e["hot"]
                    part = text[e["start"] : e["start"] + e["count"] - 1 + plan.length]
                    runs = _runs(part, e["mini"], plan) if hot else [(e["mini"], 0, e["count"] - 1)]
                    for key, a, z in runs:
                        own = part[a : z + plan.length]
                        row = key, _hash(own) if hot else e["content"], e["mini"], e["content"], a, e["times"], hot, own
                        for c, v in zip(cols, row):
                            c.append(v)
                        size += len(own)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
                    cols, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    return src.mapInArrow(run, PIECE)


def _repeats(pieces: DataFrame, plan: Plan) -> DataFrame:
    """key, content and spans (begin, end, begin, ...) of the repeated bytes of pieces (key, content, times, bytes)."""
    import pyarrow as pa

    def solve(held: dict[tuple[int, int], tuple[int, bytes]]) -> pa.RecordBatch:
        names = list(held)
        marks = repeated_starts([held[k][1] for k in names], [held[k][0] for k in names], plan.length)
        keys, contents, spans = [], [], []
        for (key, content), m in zip(names, marks):
            if m.any():
                keys.append(key)
                contents.append(content)
                spans.append(covered(np.flatnonzero(m), plan.length).ravel().tolist())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["key", "content", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, bytes]] = {}
        size, last = 0, None
        for b in batches:
            for key, content, times, x in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                if key != last and size >= plan.chunk:  # a key is never divided
                    yield solve(held)
                    held, size = {}, 0
                last = key
                if (key, content) not in held:
                    text = x.as_buffer().to_pybytes()
                    held[key, content] = times, text
                    size += len(text)
        if held:
            yield solve(held)

    dealt = pieces.select("key", "content", "times", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, content long, spans array<int>")


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """The maximal runs (begin, end) that substrings of that length from sorted starts cover."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    new = np.concatenate([[True], starts[1:] > starts[:-1] + length])
    return np.stack([starts[new], starts[np.concatenate([new[1:], [True]])] + length], 1)


def _hot_repeats(runs: DataFrame, plan: Plan) -> DataFrame:
    """mini, content, spans of the regions of hot minimizers, from the PIECE rows of their runs."""
    # Rows that repeat wholly give a region twice.
    runs = runs.groupBy("key", "content", "mini", "region", "first").agg(F.first("times").alias("times"), F.first("bytes").alias("bytes"))
    unique = materialize(runs.groupBy("key", "content").agg(F.sum("times").alias("times"), F.first("bytes").alias("bytes")), "hot-unique")
    still = unique.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > plan.hot).select("key")
    spans = _repeats(unique.join(still, "key", "left_anti"), plan)
    # Keys that still are hot: window by window, each with its own bytes as key.
    at = F.explode(F.sequence(F.lit(0), F.length("bytes") - plan.length)).alias("at")
    single = unique.join(still, "key", "left_semi").select("key", "content", "times", "bytes", at)
    window = F.substring(F.col("bytes"), F.col("at") + 1, F.lit(plan.length))
    single = materialize(single.select("key", "content", "times", "at", window.alias("w"), F.xxhash64(window).alias("k"), F.xxhash64(F.lit(5), window).alias("c")), "hot-windows")
    each = single.groupBy("k", "c").agg(F.sum("times").alias("times"), F.first("w").alias("bytes")).select(F.col("k").alias("key"), F.col("c").alias("content"), "times", "bytes")
    twice = _repeats(each, plan).select(F.col("key").alias("k"), F.col("content").alias("c"))
    ends = F.array(F.col("at"), F.col("at") + plan.length)
    spans = spans.union(single.join(twice, ["k", "c"]).select("key", "content", ends.alias("spans")))
    moved = F.transform("spans", lambda x: x + F.col("first"))
    return runs.drop("times", "bytes").join(spans, ["key", "content"]).select("mini", F.col("region").alias("content"), moved.alias("spans"))


def repeated_spans(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """_row and found, an array of (start, spans): what is repeated of each text, spans counted from start."""
    # A join's strategy doesn't depend on the size of what was found: always a shuffle of these narrow rows.
    every = materialize(all_regions(docs, plan), "regions")
    several = every.groupBy("mini").agg(F.sum(F.when(F.col("ties"), 2).otherwise(1)).alias("n"), salts("_row")).where(F.col("n") > 1).drop("n")
    kept = materialize(join_hot(every.drop("ties"), several, ["mini"], "_row", "merge"), "repeated-regions")
    place = F.struct("_row", "start", "count")
    classes = kept.groupBy("mini", "content").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("p"), salts("_row"))
    classes = materialize(classes.select("mini", "content", "times", "_salts", "p.*"), "classes")
    hot = materialize(classes.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > plan.hot).select("mini"), "hot")
    if hot.isEmpty():
        pieces, runs = _pieces(docs, classes.withColumn("hot", F.lit(False)), plan), None
    else:
        told = classes.join(hot.withColumn("hot", F.lit(True)), "mini", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        both = materialize(_pieces(docs, told, plan), "pieces")
        pieces, runs = both.where(~F.col("hot")), both.where("hot")
    spans = _repeats(pieces, plan).select(F.col("key").alias("mini"), "content", "spans")
    if runs is not None:
        spans = spans.union(_hot_repeats(runs, plan))
    spans = materialize(spans, "repeats").join(classes.select("mini", "content", "_salts"), ["mini", "content"])
    found = join_hot(kept, spans, ["mini", "content"], "_row", "merge")
    return found.groupBy("_row").agg(F.collect_list(F.struct("start", "spans")).alias("found"))


def cut_repeats(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_bytes, spans (the maximal runs cut out: begin, end, begin, ...) and kept (the other bytes) of docs (doc_id, text)."""
    import pyarrow as pa

    found = materialize(repeated_spans(docs, plan), "found")
    src = docs.select("doc_id", row_key().alias("_row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    src = src.join(found, "_row", "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, kept = [], [], []
            for x, got in zip(b.column(1), b.column(2).to_pylist()):
                text = x.as_buffer().to_pybytes()
                sizes.append(len(text))
                runs: list[int] = []
                for begin, end in sorted((g["start"] + i, g["start"] + j) for g in got or () for i, j in zip(g["spans"][::2], g["spans"][1::2])):
                    if runs and begin <= runs[-1]:
                        runs[-1] = max(runs[-1], end)
                    else:
                        runs += [begin, end]
                spans.append(runs)
                cuts = [0, *runs, len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2])))
            cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<int>, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
