"""Scores by a log-bilinear language model, trained in numpy with noise-contrastive estimation.

Tokens are the lower-cased words and one end for each document. The model predicts symbols: the end,
the most frequent words, and buckets of all other words (by their last two bytes). The vector of
the next symbol is predicted as a linear function of those of the two before it, its score is its dot
product with the symbol's vector plus a bias, and a word of a bucket is drawn by its smoothed
frequency there, with room for one word never seen. So the probabilities of all words sum to one.

Steps, all over the whole corpus:
1. words of the training documents are counted (summed in each task, then by word);
2. every text becomes an array of 16-bit symbols; words outside the ``dictionary`` most frequent
   ones, which all executors get, are joined with their counts by a shuffle;
3. a start is trained on ``warm_docs`` documents (of ``warm_bytes`` at most), a bounded sample; then the training
   documents are dealt by a hash into parts of about ``part_tokens``, each in the order of that hash, every task trains on
   all of its part from there, and the models are averaged by their tokens: the scores depend on the documents alone, not
   on how they are stored or on the cluster;
4. the normaliser of every pair of context symbols comes from batched matrix products, so each
   token's log-probability is exact and costs one look-up.

Defined results: a null or empty text is one end token; null ids count as an empty id text; repeated
rows are counted and scored each; without training tokens all counts are zero and the model uniform;
an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize, words


@dataclass(frozen=True)
class Shape:
    frequent: int = 447
    buckets: int = 64
    size: int = 16
    noise: int = 32
    batch: int = 4096
    dictionary: int = 200_000
    #: Longer words (bytes) are not in the dictionary but looked up by the shuffle, so its size is bounded.
    longest: int = 200
    warm_docs: int = 2000
    warm_bytes: int = 32_000_000
    warm_epochs: int = 4
    part_tokens: int = 2_000_000

    @property
    def symbols(self) -> int:
        return 1 + self.buckets + self.frequent


class LogBilinear:
    """R: vectors of context symbols, c1 and c2: what the last and the one before it count, Q and b: of predicted symbols."""

    NAMES = ("R", "c1", "c2", "Q", "b")

    def __init__(self, shape: Shape, unigram: np.ndarray):
        rng = np.random.default_rng(5)
        k, d = shape.symbols, shape.size
        self.shape = shape
        self.p = {
            "R": rng.normal(0, 0.1, (k, d)).astype(np.float32),
            "c1": np.ones(d, np.float32),
            "c2": np.full(d, 0.5, np.float32),
            "Q": rng.normal(0, 0.1, (k, d)).astype(np.float32),
            "b": np.log(unigram).astype(np.float32),
        }
        self.unigram = unigram
        self.steps = {n: np.full_like(v, 1e-6) for n, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = flat[at : at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size

    def _step(self, name: str, g: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        at = slice(None) if rows is None else rows
        self.steps[name][at] += g * g
        self.p[name][at] -= rate * g / np.sqrt(self.steps[name][at])

    @staticmethod
    def _sum_rows(index: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(index, kind="stable")
        rows, first = np.unique(index[order], return_index=True)
        return rows, np.add.reduceat(g[order], first, axis=0)

    def train(self, s: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One pass over the symbols s; zeros end documents."""
        far, near = _contexts(s)
        k, n = self.shape.noise, self.shape.batch
        log_noise = np.log(k * self.unigram).astype(np.float32)
        cumulative = np.cumsum(self.unigram)
        for at in range(0, len(s), n):
            w, i1, i2 = s[at : at + n], near[at : at + n], far[at : at + n]
            p, m = self.p, len(w)
            noise = np.minimum(np.searchsorted(cumulative, rng.random(k) * cumulative[-1]), len(cumulative) - 1)
            r1, r2 = p["R"][i1], p["R"][i2]
            h = r1 * p["c1"] + r2 * p["c2"]
            qw, qn = p["Q"][w], p["Q"][noise]
            true = (h * qw).sum(1) + p["b"][w] - log_noise[w]
            false = h @ qn.T + (p["b"][noise] - log_noise[noise])
            gt = -1 / (1 + np.exp(np.clip(true, -30, 30)))
            gf = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
            dh = gt[:, None] * qw + gf @ qn
            rows, g = self._sum_rows(np.concatenate([w, noise]), np.concatenate([gt[:, None] * h, gf.T @ h]))
            rows_b, gb = self._sum_rows(np.concatenate([w, noise]), np.concatenate([gt, gf.sum(0)]))
            rows_r, gr = self._sum_rows(np.concatenate([i1, i2]), np.concatenate([dh * p["c1"], dh * p["c2"]]))
            dc1, dc2 = (dh * r1).sum(0) / m, (dh * r2).sum(0) / m
            self._step("Q", g / m, rate, rows)
            self._step("b", gb / m, rate, rows_b)
            self._step("R", gr / m, rate, rows_r)
            self._step("c1", dc1, rate / 4)
            self._step("c2", dc2, rate / 4)

    def normalisers(self) -> np.ndarray:
        """Natural log of the sum over all symbols, for each pair (one before last, last)."""
        p = self.p
        out = np.empty((len(p["R"]), len(p["R"])), np.float32)
        last = p["R"] * p["c1"]
        for i, row in enumerate(p["R"] * p["c2"]):
            x = (last + row) @ p["Q"].T + p["b"]
            top = x.max(1)
            out[i] = top + np.log(np.exp(x - top[:, None]).sum(1))
        return out

    def log10(self, s: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of each symbol's probability after the two before it."""
        far, near = _contexts(s)
        p = self.p
        h = p["R"][near] * p["c1"] + p["R"][far] * p["c2"]
        return ((h * p["Q"][s]).sum(1) + p["b"][s] - z[far, near]).astype(float) / np.log(10)


def _contexts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two before and one before each; ends where a document begins."""
    near = np.concatenate([[0], s[:-1]]).astype(s.dtype)
    far = np.concatenate([[0], near[:-1]]).astype(s.dtype)
    far[near == 0] = 0
    return far, near


def bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-2:]) % buckets


class Vocabulary:
    """What executors need of the counts: a bounded dictionary and the sums of the buckets."""

    def __init__(self, shape: Shape, top: list[tuple[bytes, int]], sums: dict[int, tuple[int, int]], n: int, v: int, ends: int):
        self.shape, self.n, self.v, self.ends = shape, n, v, ends
        self.words = b"\n".join(w for w, _ in top)
        self.counts = np.array([c for _, c in top], np.int64)
        self.room = np.array([sum(sums.get(b, (0, 0))) + 1 for b in range(shape.buckets)], np.int64)
        mass = np.ones(shape.symbols)
        mass[0] += ends
        mass[1 : 1 + shape.buckets] += [sums.get(b, (0, 0))[0] for b in range(shape.buckets)]
        f = min(shape.frequent, len(top))
        mass[1 + shape.buckets : 1 + shape.buckets + f] += self.counts[:f]
        self.unigram = mass / mass.sum()

    def open(self) -> None:
        """Makes the look-up tables, in the process that uses them."""
        m = self.shape.buckets
        names = self.words.split(b"\n") if self.words else []
        self.rank = {w: i for i, w in enumerate(names)}
        own = np.array([bucket(w, m) for w in names], np.int64)
        frequent = np.arange(len(names)) < self.shape.frequent
        self.symbol = np.where(frequent, 1 + m + np.arange(len(names)), 1 + own).astype(np.uint16)
        self.log_count = np.log10(self.counts + 1.0)
        self.within = np.where(frequent, 0.0, self.log_count - np.log10(self.room[own] if len(own) else own + 1.0))


def _symbols(docs: DataFrame, vocabulary) -> DataFrame:
    """Rows of docs (_row, text binary and more) as symbols and the sums that the dictionary gives."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        v.open()
        get, m = v.rank.get, v.shape.buckets
        log_room, log_end = np.log10(v.room), float(np.log10(v.ends + 1))
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for x in b.column(b.schema.get_field_index("text")).to_pylist():
                w = x.lower().split()
                ranks = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
                s = np.zeros(len(w) + 1, np.uint16)
                rare = np.flatnonzero(ranks < 0)
                known = ranks[ranks >= 0] if len(rare) else ranks
                s[:-1] = v.symbol[ranks] if len(v.symbol) else 0
                base, within = v.log_count[known].sum() + log_end, v.within[known].sum()
                names = [w[i] for i in rare.tolist()]
                if names:
                    own = np.array([bucket(y, m) for y in names])
                    s[rare] = 1 + own
                    within -= log_room[own].sum()
                for c, y in zip(cols, (s.tobytes(), len(s), len(known) + (v.ends > 0), float(base), float(within), names)):
                    c.append(y)
            kinds = pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())
            keep = [n for n in b.schema.names if n != "text"]
            names_out = [*keep, "symbols", "n_tokens", "n_known", "log_counts", "within", "rare"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), *(pa.array(c, t) for c, t in zip(cols, kinds))], names_out)

    keep = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text"]
    return docs.mapInArrow(run, ", ".join(keep) + ", symbols binary, n_tokens long, n_known long, log_counts double, within double, rare array<binary>")


def _trained(rows: DataFrame, model: LogBilinear, rate: float, tokens: int, adders: int = 32) -> np.ndarray:
    """The mean of the models that parts of rows (symbols, o) of about part_tokens end with, weighted by tokens."""
    import pyarrow as pa

    start = rows.sparkSession.sparkContext.broadcast((model.shape, model.unigram, model.flat(), model.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, unigram, flat, steps = start.value
        own = LogBilinear(shape, unigram)
        own.load(flat)
        own.steps = {k: v.copy() for k, v in steps.items()}
        rng, n = np.random.default_rng(9), 0
        held: list[bytes] = []
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(x)
                if len(held) >= 512:
                    s = np.frombuffer(b"".join(held), np.uint16).astype(np.int64)
                    own.train(s, rate, rng)
                    n, held = n + len(s), []
        if held:
            s = np.frombuffer(b"".join(held), np.uint16).astype(np.int64)
            own.train(s, rate, rng)
            n += len(s)
        if n:
            yield _model_row((own.flat().astype(float) * n).tobytes(), n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(x)
                total, n = v if total is None else total + v, n + k
        if n:
            yield _model_row(total.tobytes(), n)

    kind = "model binary, n long"
    parts = -(-tokens // model.shape.part_tokens)
    dealt = rows.select("symbols", "o").repartition(parts, "o").sortWithinPartitions("o", "symbols")
    sums = dealt.select("symbols").mapInArrow(run, kind).repartition(adders).mapInArrow(add, kind).collect()  # adders rows at most
    if not sums:
        return model.flat()
    return sum(np.frombuffer(r.model) for r in sums) / sum(r.n for r in sums)


def _model_row(model: bytes, n: int):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([model], pa.binary()), pa.array([n], pa.int64())], ["model", "n"])


def _scored(rows: DataFrame, model: LogBilinear) -> DataFrame:
    """rows with model_score in the place of symbols."""
    import pyarrow as pa

    given = rows.sparkSession.sparkContext.broadcast((model.shape, model.unigram, model.flat(), model.normalisers()))
    keep = [n for n in rows.columns if n != "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, unigram, flat, z = given.value
        own = LogBilinear(shape, unigram)
        own.load(flat)
        for b in batches:
            texts, scores = b.column(b.schema.get_field_index("symbols")).to_pylist(), []
            at = 0
            while at < len(texts):
                take, size = at, 0
                while take < len(texts) and (size < 400_000 or take == at):
                    size += len(texts[take])
                    take += 1
                part = texts[at:take]
                each = own.log10(np.frombuffer(b"".join(part), np.uint16).astype(np.int64), z)
                first = np.cumsum([0, *(len(x) // 2 for x in part[:-1])])
                scores.append(np.add.reduceat(each, first))
                at = take
            out = pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), out], [*keep, "model_score"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "symbols") + ", model_score double")


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words and counts, the most frequent first, of as many whole steps of frequency as have at most ``most`` words.

    The number of words in each step (1,024 at most) tells which are gathered; nothing is sorted or cut on the executors.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    held, lowest = 0, None
    for s, n in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += n
        if held > most:
            break
        lowest = s
    if lowest is None:
        return []
    table = counts.where(step >= lowest).select("word", "c").toArrow()
    return sorted(zip(map(bytes, table.column("word").to_pylist()), table.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))


def _warm(learn: DataFrame, docs: int, shape: Shape) -> np.ndarray:
    """The symbols of the documents with the smallest hashes o, equal rows once: warm_docs and warm_bytes of them at most."""
    # The hash is uniform, so a bound on it leaves about twice as many rows as wanted, whatever the number of partitions.
    share = min(1.0, 2 * (shape.warm_docs + 100) / max(docs, 1))
    below = F.col("o") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)
    sizes = learn.where(below).groupBy("o").agg(F.max(F.length("symbols")).alias("size")).collect()
    total, last = 0, None
    for r in sorted(sizes)[: shape.warm_docs]:
        total += r["size"]
        if total > shape.warm_bytes:
            break
        last = r.o
    if last is None:
        return np.empty(0, np.int64)
    rows = learn.where(F.col("o") <= last).groupBy("o").agg(F.max("symbols").alias("symbols")).collect()
    return np.frombuffer(b"".join(bytes(r.symbols) for r in sorted(rows)), np.uint16).astype(np.int64)


def _fitted(learn: DataFrame, vocabulary: Vocabulary, rate: float) -> LogBilinear:
    """The model trained on learn (doc_id, symbols)."""
    shape = vocabulary.shape
    model = LogBilinear(shape, vocabulary.unigram)
    learn = learn.select("symbols", F.xxhash64(F.col("doc_id").cast("string"), "symbols").alias("o"))
    warm = _warm(learn, vocabulary.ends, shape)
    for i in range(shape.warm_epochs if len(warm) else 0):
        model.train(warm, rate, np.random.default_rng(i))
    if vocabulary.ends:
        model.load(_trained(learn, model, rate / 2, vocabulary.n))
    return model


def score(docs: DataFrame, held_out, shape: Shape = Shape(), rate: float = 0.1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text).

    held_out: a boolean Column; the model learns from the documents where it is false.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # Lower-casing bytes touches A-Z alone; the JVM's lower() would touch others.
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    training = docs.where(~F.col("held_out"))
    counts = training.select(F.explode(words(lowered)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts.select(F.col("word").cast("binary").alias("word"), "c"), "word-counts")
    ends = training.select("doc_id").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    n, v = n + ends, v + (ends > 0)
    too_long = F.length("word") > shape.longest
    top = most_frequent(counts.where(~too_long), shape.dictionary)
    cut = top[: shape.frequent]
    # The frequent words are the first in that order; all others are in buckets.
    in_bucket = counts.where((F.col("c") < cut[-1][1]) | ((F.col("c") == cut[-1][1]) & (F.col("word") > F.lit(cut[-1][0]))) | too_long) if cut else counts
    of = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(shape.buckets)).cast("int")
    sums = {r.b: (r.n, r.v) for r in in_bucket.groupBy(of.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    vocabulary = Vocabulary(shape, top, sums, n, v, ends)
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = materialize(_symbols(docs, shared).withColumn("_row", F.expr("uuid()")), "symbols")

    model = _fitted(rows.where(~F.col("held_out")), vocabulary, rate)

    known = counts.select("word", F.log10(F.col("c") + F.lit(1.0)).alias("l"))
    rare = rows.select("_row", F.explode("rare").alias("word")).join(known, "word").groupBy("_row").agg(F.sum("l").alias("l"), F.count(F.lit(1)).alias("k"))
    out = _scored(rows.drop("rare"), model).join(rare, "_row", "left")
    extra = F.coalesce("l", F.lit(0.0))
    log_all = float(np.log10(n + v + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + extra - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("model_score") + F.col("within") + extra).alias("score"),
    )


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2)
