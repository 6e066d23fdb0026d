"""Each operator against plain Python, on awkward rows and on the smallest tables."""

import collections
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bwt, common, decontaminate, line_dedup, lm_scores, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, url_filters
from tests.llm import brute

tokenizers_files = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"

PASSAGE = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, PASSAGE), (7, PASSAGE), (8, PASSAGE.upper()), (9, PASSAGE + " more"),
    (10, "this very line is shared by many\nown ten\n\nthis very line is shared by many"), (11, "  THIS very line is shared by many \r\nown eleven"),
    (12, "x\nthis very line is shared by many"), (13, "é" * 300), (14, "é" * 300 + "z"), (15, "ab" * 400), (16, "long " * 5000),
    (17, "<|endoftext|> \x1c日本語 テキスト Ünïcödé"), (18, "Line\twith\x0btabs\x0c"), (20, "the end"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("source", "n", "start", "h1", "_row", "_gone", "count", "n_tokens", "n_frequent_words", "id", "key")})


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows that repeat, ids that repeat with other texts, and a null id."""
    return spark.createDataFrame([*AWKWARD, *AWKWARD[:9], (6, "another text of the same id, with words enough"), (None, PASSAGE), (None, None)], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def real(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


# ---- 1


def check_packing(df, rows, spark):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(df, lambda: packing.WordIds(path), with_ids=True).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, text in rows:
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        parts = sorted(by[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == want
        at = 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(want) // 4
            at += r.length
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(s) <= 256
    return seqs


def test_packing(spark, awkward, repeated, none, real):
    check_packing(awkward, AWKWARD, spark)
    seqs = check_packing(spark.createDataFrame(real, "doc_id long, text string").coalesce(1), real, spark)
    tokens = sum(r.length for s in seqs.values() for r in s)
    assert tokens / (2048 * len(seqs)) > 0.98
    path = tokenizers_files.path("word_bpe_49k.json")
    assert packing.pack(none, lambda: packing.WordIds(path)).count() == 0
    assert packing.pack(repeated, lambda: packing.WordIds(path)).where("start = 0").count() == repeated.count()


def test_packing_tasks_of_a_worker_share_words(monkeypatch, real):
    """The tasks that a worker runs one after another encode a word once; what is kept stays right when it is swapped."""
    import corpus_pipeline
    from pyspark import cloudpickle
    from tokenizers import Tokenizer

    path, given = tokenizers_files.path("word_bpe_49k.json"), []
    monkeypatch.setattr(packing, "pack", lambda docs, encoder: given.append(encoder))

    class Any:
        def __getattr__(self, name):
            return self if name == "read" else lambda *a: self

    packing.op1_packing(Any(), DIR)
    corpus_pipeline.packing_stage(Any(), Any(), DIR)
    for encoder in given:
        task, after = (cloudpickle.loads(cloudpickle.dumps(encoder)) for _ in range(2))
        assert task() is after()
    assert len(packing._encoders) == 1
    t, small = Tokenizer.from_file(path), packing.WordIds(path, cache=50)
    texts = [(text or "").encode() for _, text in AWKWARD + real[:60]]
    want = [np.array(t.encode(x.decode(), add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for encode in (given[0](), small):
        for _ in range(2):
            assert [ids for i in range(0, len(texts), 7) for ids in encode(texts[i : i + 7])] == want


def test_packing_keeps_limits_without_cuts():
    rng = np.random.default_rng(1)
    pieces = [packing.Piece(i, 0, bytes(4 * int(n)), int(n), int(n) - int(m)) for i, (n, m) in enumerate(zip(rng.integers(1, 100, 400), rng.integers(0, 40, 400))) if n >= m]
    limits = packing.Limits(tokens=120, segments=3, loss=50)
    bins = packing.pack_block(pieces, limits, cut=False)
    assert sorted(p.doc for b in bins for p in b) == [p.doc for p in pieces]
    for b in bins:
        assert sum(map(len, b)) <= 120 and len(b) <= 3 and sum(p.loss for p in b) <= 50
    for b in packing.pack_block(pieces, limits, cut=True):
        assert sum(map(len, b)) <= 120 and len(b) <= 3 and sum(p.loss for p in b) <= 50


# ---- 2


@pytest.mark.parametrize("plan", [suffix_dedup.Plan(), suffix_dedup.Plan(hot=2, chunk=5000), suffix_dedup.Plan(hot=0)])
def test_suffix_dedup(spark, awkward, plan):
    want = brute.cut_repeats(AWKWARD)
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(awkward, plan).collect()}
    assert {i: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, bytes(r.kept)) for i, r in got.items()} == want


def test_suffix_dedup_fetches_texts_once(spark, monkeypatch):
    """Regions of hot and of other minimizers are cut from one shuffle of the texts."""
    rng = np.random.default_rng(3)
    own = lambda: " ".join(map(str, rng.integers(10**8, 10**9, 60)))
    twice = own()
    rows = [(i, f"{own()} {PASSAGE} {own()}") for i in range(12)] + [(20, f"{twice} a {own()}"), (21, f"{own()} b {twice}"), (22, own())]
    made = []
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, tag, f=suffix_dedup.materialize: made.append((tag, f(df, tag))) or made[-1][1])
    got = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), suffix_dedup.Plan(hot=4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, bytes(r.kept)) for r in got} == brute.cut_repeats(rows)
    assert [tag for tag, _ in made].count("want") == 1
    assert {r.hot for r in dict(made)["pieces"].select("hot").distinct().collect()} == {True, False}


def test_suffix_merge_refines_open_blocks_only(monkeypatch):
    """Suffixes that one shard alone has, or that end, are not merged any further; the marks are those of a count of all windows."""
    rng = np.random.default_rng(5)
    own = lambda n: rng.integers(97, 123, n, np.uint8).tobytes()
    passages, tail = [own(300) for _ in range(5)], own(150)
    strings = [own(int(rng.integers(0, 90))) + passages[k // 9][int(rng.integers(0, 60)) :] + own(int(rng.integers(0, 90))) + tail for k in range(45)]
    strings += [b"ab" * 150, b"a" * 500, b"a" * 199, b"b" + b"a" * 200, "é".encode() * 130, own(700), b""]
    for order in (range(len(strings)), rng.permutation(len(strings))):
        given = [strings[i] for i in order]
        weights = [1 + (i % 11 == 0) for i in range(len(given))]
        count = collections.Counter(x[i : i + 200] for x, w in zip(given, weights) for i in range(len(x) - 199) for _ in range(w))
        want = [[count[x[i : i + 200]] > 1 for i in range(len(x) - 199)] for x in given]
        assert [m.tolist() for m in bwt.repeated_starts(given, weights)] == want
    moved = []
    monkeypatch.setattr(bwt.np, "sort", lambda x, f=np.sort, **k: moved.append(len(x)) or f(x, **k))
    shared = [[own(300) for _ in range(8)] for _ in range(4)]
    given = [own(40) + p + own(40) + tail for four in shared for p in four for _ in range(2)]
    marks = bwt.repeated_starts(given, [1] * len(given))
    assert all(101 <= m.sum() < 110 for m in marks)  # the shared 300 bytes, and neighbours equal by chance
    size = sum(map(len, given))
    # The tails alone are in all shards: 142 of their 150 starts in the first step and eight fewer with each one more.
    assert sum(moved) < 1.1 * len(given) * sum(range(142, 0, -8)) and max(moved) < size / 3


def test_suffix_dedup_real(spark, real, none, repeated):
    want = brute.cut_repeats(real)
    got = {r.doc_id: r for r in suffix_dedup.op2_suffix_dedup(spark, DIR).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (*w[:3], brute.sha(w[3])) for i, w in want.items()}
    assert suffix_dedup.cut_repeats(none).count() == 0
    assert suffix_dedup.cut_repeats(repeated).where("doc_id = 6 AND n_bytes > 200 AND length(kept) > 0").count() == 0


# ---- 3


def test_decontaminate(spark, awkward, repeated, none):
    items = [(1, PASSAGE), (2, "a b c d"), (3, None), (4, ""), (5, " ".join(PASSAGE.split()[10:40])), (6, "never seen anywhere at all by anyone here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.judge(awkward, bench).collect()}
    for i, t in AWKWARD:
        want = brute.leaks(t, [x for x in items if x[1]])
        assert (got[i].contaminated, got[i].n_items) == (bool(want), len(want)), i
    shuffled = {r.doc_id: r.contaminated for r in decontaminate.judge(awkward, bench, broadcast_shingles=0).collect()}
    assert shuffled == {i: r.contaminated for i, r in got.items()}
    assert decontaminate.judge(repeated, bench).count() == repeated.count()
    assert decontaminate.judge(none, bench).count() == 0
    assert decontaminate.judge(awkward, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.keep_clean(awkward.select("doc_id", "text"), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}


def test_items_that_share_an_id(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(12))
    bench = spark.createDataFrame([(1, text("a")), (1, text("b")), (1, text("b")), (None, text("c")), (None, text("d"))], "item_id long, text string")
    docs = spark.createDataFrame([*((i, f"so {text(c)} it is") for i, c in enumerate("abcde")), (9, f"{text('b')} {text('d')}")], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_id) for r in decontaminate.judge(docs, bench).collect()}
    assert got == {0: (True, 1, 1), 1: (True, 1, 1), 2: (True, 1, None), 3: (True, 1, None), 4: (False, 0, None), 9: (True, 2, 1)}


def test_fingerprints_find_what_is_similar_and_little_else(spark):
    """Recall of the block lookup at the threshold, for edits of all kinds, and the candidates among windows that are like no item."""
    rng = np.random.default_rng(11)
    items, windows, want = [], [], set()
    for i in range(300):
        n = int(rng.integers(20, 120))
        item = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        items.append((i, n, item))
        for kind in range(3):
            w, lost = list(item), 0
            # As many edits as leave 75 per cent: of words here and there, of words at an end, of a run in the middle.
            while True:
                v = list(w)
                at = {0: int(rng.integers(0, n)), 1: n - 1 - lost, 2: n // 2 + lost}[kind]
                v[at] = f"x{rng.integers(0, 50_000)}"
                grams = [collections.Counter(tuple(t[j : j + 5]) for j in range(n - 4)) for t in (item, v)]
                same = sum((grams[0] & grams[1]).values())
                if 100 * same < 75 * (2 * (n - 4) - same):
                    break
                w, lost = v, lost + 1
            windows.append(((i, kind), n, 0, w))
            want.add((i, kind, i))
    for i in range(1000):
        n = int(rng.integers(20, 120))
        windows.append(((i, 9), n, 0, [f"w{x}" for x in rng.integers(0, 50_000, n)]))
    got = decontaminate.candidates(
        spark.createDataFrame([((a, b), n, s, w) for (a, b), n, s, w in windows], "_row struct<a:long,b:long>, len int, start int, w array<string>"),
        spark.createDataFrame(items, "_item long, len int, w array<string>"),
    )
    got = {(r._row.a, r._row.b, r._item) for r in got.collect()}
    assert len(got & want) >= 0.995 * len(want)
    assert len(got - want) <= 0.001 * len(windows) * len(items) / 100  # a hundred lengths


# ---- 4


def plain_score(tokens, vocabulary, model, counts):
    """log10 of the product of the model's probabilities of tokens (None: the end), by sums over all symbols."""
    shape, p = vocabulary.shape, model.p
    top = vocabulary.words.split(b"\n")
    symbol_of = {w: 1 + shape.buckets + i for i, w in enumerate(top[: shape.frequent])}
    bucket = lambda w: zlib.crc32(w[-2:]) % shape.buckets
    rare = [w for w in counts if w is not None and w not in symbol_of]
    mass = {b: sum(counts[w] + 1 for w in rare if bucket(w) == b) + 1 for b in range(shape.buckets)}
    total, far, near = 0.0, 0, 0
    for t in tokens:
        s = 0 if t is None else symbol_of.get(t, 1 + bucket(t))
        h = p["R"][near].astype(float) * p["c1"] + p["R"][far].astype(float) * p["c2"]
        z = p["Q"].astype(float) @ h + p["b"]
        total += (z[s] - np.log(np.exp(z).sum())) / np.log(10)
        if 0 < s <= shape.buckets:
            total += np.log10((counts[t] + 1) / mass[s - 1])
        far, near = (0, 0) if t is None else (near, s)
    return total


def test_lm_score_is_what_the_parameters_say(spark, real, monkeypatch):
    shape, held = lm_scores.Shape(frequent=60, buckets=7, size=6, warm_docs=50, dictionary=500, part_tokens=5000), F.col("doc_id") % 5 == 2
    fitted, keep = lm_scores._fitted, {}

    def spy(learn, vocabulary, rate):
        keep["vocabulary"], keep["model"] = vocabulary, fitted(learn, vocabulary, rate)
        return keep["model"]

    monkeypatch.setattr(lm_scores, "_fitted", spy)
    docs = spark.createDataFrame(real, "doc_id long, text string")
    one = {r.doc_id: r.score for r in lm_scores.score(docs.coalesce(1), held, shape).collect()}
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in real}
    counts = collections.Counter(w for i in toks if i % 5 != 2 for w in toks[i])
    for i in list(toks)[::7]:
        assert one[i] == pytest.approx(plain_score(toks[i], keep["vocabulary"], keep["model"], counts), rel=1e-4), i
    # However the documents are stored.
    other = {r.doc_id: r.score for r in lm_scores.score(docs.repartition(7), held, shape).collect()}
    assert other == pytest.approx(one, rel=1e-6)


def test_lm_scores(spark, repeated, none, real):
    shape = lm_scores.Shape(warm_docs=100, dictionary=500)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    got = lm_scores.score(spark.createDataFrame(real, "doc_id long, text string"), held, shape).collect()
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in real}
    c = collections.Counter(w for i in toks if zlib.crc32(str(i).encode()) % 7 != 2 for w in toks[i])
    n, v = sum(c.values()), len(c)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks[r.doc_id]), sum(c[w] > 0 for w in toks[r.doc_id]), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in toks[r.doc_id]))
        assert np.isfinite(r.score)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than the base on texts not seen
    assert lm_scores.score(repeated, F.lit(False), shape).where("score IS NOT NULL").count() == repeated.count()
    assert lm_scores.score(none, F.lit(False), shape).count() == 0
    assert lm_scores.score(repeated, F.lit(True), shape).where("n_known = 0").count() == repeated.count()


def test_lm_is_normalised():
    shape = lm_scores.Shape(frequent=5, buckets=2, size=4)
    m = lm_scores.LogBilinear(shape, np.full(8, 1 / 8))
    m.train(np.random.default_rng(0).integers(0, 8, 5000), 0.1, np.random.default_rng(1))
    z = m.normalisers()
    for last in range(8):
        total = sum(10 ** m.log10(np.array([1, last, s]), z)[2] for s in range(8))
        assert total == pytest.approx(1, abs=1e-4)


# ---- 5


def test_url_filters(spark):
    rows = [(1, "http://A.b.net/x"), (2, "https://example.net/en/1?q"), (3, "http://x.example.com/de/#t"), (4, "ftp://org/fr/1"), (5, None), (6, "no scheme"), (7, "http://net"), (8, "://h.org/"), (8, "://h.org/"), (None, "http://badnet/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"bad": F.lit(None).cast("int"), "host": F.lit(0), "shape": F.lit(1)})
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect())
    assert got == collections.Counter(
        [(1, "a.b.net", "/x", "net/", "block"), (2, "example.net", "/en/1", "example.net/en/", "allow"), (3, "x.example.com", "/de/", "example.com/de/", "block"), (4, "org", "/fr/1", "org/fr/", "allow"),
         (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "net", "", None, "allow"), (8, "h.org", "/", None, "allow"), (8, "h.org", "/", None, "allow"), (None, "badnet", "/", None, "allow")]
    )
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.com/{'spam' if i % 2 else f'topic{i % 8}x'}/{i}.html", i % 2) for i in range(400)]
    out = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in out)
    assert "/spam/*.html" in {r.template for r in out}


# ---- 6


def test_sharding(spark, awkward, repeated, none):
    for df in (awkward, repeated, spark.read.parquet(f"{DIR}/documents.parquet")):
        got = sharding.shard(df).toPandas()
        assert len(got) == df.count()
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() < 1.1 * loads.mean()
    texts = dict(AWKWARD)
    for r in sharding.shard(awkward).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard(none).count() == 0


def plain_shards(rows, shards=8, nodes=64, slack=0.001, cells=1 << 14, split=256):
    """The shard of each row (doc_id, text) by walking the ring key by key; no text is large enough to be cut."""
    import hashlib
    import struct

    import xxhash

    key = {t: xxhash.xxh64_intdigest((t or "").encode(), 42) for _, t in rows}
    size = collections.Counter()
    for _, t in rows:
        size[key[t]] += len((t or "").encode()) + 1
    copies, total = collections.Counter(key[t] for _, t in rows), sum(size.values())
    cell = {k: k >> 50 for k in size}
    load = collections.Counter()
    for k in size:
        load[cell[k]] += size[k]
    large = total / (8 * cells / split)
    groups = collections.defaultdict(int)  # (cell, what is placed together)
    of = {}
    for number, k in enumerate(sorted(size, key=lambda k: k - (1 << 64) if k >> 63 else k)):
        if load[cell[k]] < large:
            of[k] = cell[k], 0
        elif size[k] >= large and copies[k] > 1:
            assert 2 * shards * size[k] < total
            of[k] = cell[k], 1 + number
        else:
            seed = xxhash.xxh64_intdigest(struct.pack("<i", 5), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<Q", k), seed)
            of[k] = cell[k], -1 - (h - (1 << 64) if h >> 63 else h) % split
        groups[of[k]] += size[k]
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(nodes))
    filled, where = [0] * shards, {}
    for g in sorted(groups, key=lambda g: (-groups[g] if groups[g] >= large else 0, g)):
        clockwise = [s for p, s in points if p >= g[0] << 50] + [s for p, s in points if p < g[0] << 50]
        fits = [s for s in clockwise if filled[s] + groups[g] <= (1 + slack) * total / shards]
        where[g] = fits[0] if fits else min(range(shards), key=lambda s: (filled[s], s))
        filled[where[g]] += groups[g]
    return [(i, where[of[key[t]]]) for i, t in rows]


def test_shards_by_the_plain_ring(spark):
    for n in ("0.001", "0.01"):
        df = spark.read.parquet(f"/root/testdata/sf{n}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = sharding.shard(df).toPandas()
        assert sorted(zip(got.doc_id, got.shard)) == sorted(plain_shards(rows))
        where = dict(zip(got.doc_id, got.shard))
        groups = collections.defaultdict(set)
        for i, t in rows:
            groups[t].add(where[i])
        assert all(len(g) == 1 for g in groups.values())  # equal texts lie together


def test_a_text_too_large_for_a_shard_is_cut(spark):
    rows = [(i, "the same text over and over again") for i in range(600)] + [(1000 + i, f"own text {i}") for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() < 1.2 * loads.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_ring_moves_little():
    cells = [(c, 0, 1, 100) for c in range(1 << 12)]
    a, b = (sharding.place(cells, n, 64, 0.05, (1 << 64) >> 12) for n in (8, 9))
    assert max(collections.Counter(a).values()) <= 1.05 * len(cells) / 8
    assert sum(x != y for x, y in zip(a, b)) < 0.35 * len(cells)


# ---- 7


def test_token_counts(spark, awkward, repeated, none):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(awkward, path).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in AWKWARD}
    assert token_counts.count_tokens(repeated, path).count() == repeated.count()
    assert token_counts.count_tokens(none, path).count() == 0
    rng = np.random.default_rng(3)
    m, alphabet = token_counts.merger(path), [" ", "  ", "\n", "\t", "a", "B", "'s", "'", "é", "1", "!", "日", "\xa0", "\x85", "\x1c", "<|endoftext|>", "　", "ll", "x²"]
    for _ in range(500):
        s = "".join(rng.choice(alphabet, rng.integers(1, 12)))
        assert m.count(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)


def test_token_counts_of_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers_files.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in token_counts.op7_token_counts(spark, DIR).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


# ---- 8


def test_quality(spark, awkward, repeated, none, real):
    got = {r.doc_id: r for r in quality.judge(awkward).collect()}
    for i, t in AWKWARD:
        failed, covered = brute.base_failed(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        r = got[i]
        assert (r.n_words, r.base_failed, r.n_repeat_words, r.n_dup_lines) == (len(brute.words(t)), failed, covered, len(lines) - len(set(lines))), i
        assert r.word_chars == sum(map(len, brute.words(t)))
    assert quality.judge(repeated).count() == repeated.count() and quality.judge(none).count() == 0
    bad = {r.doc_id for r in quality.judge(awkward).where("NOT kept").collect()}
    assert {r.doc_id for r in quality.keep_good(awkward.select("doc_id", "text", "source")).collect()} == {i for i, _ in AWKWARD} - bad


def test_depleted_documents_go(spark):
    line = "the same boilerplate line stands in all of these documents of the host"
    rows = [(i, f"{line}\nown words of letter {chr(97 + i) * 3} and so they go on and on", "h") for i in range(5)] + [(9, line + "\n" + line, "h"), (10, line, "other")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), limit=3).collect()}
    assert got == {**{i: True for i in range(5)}, 9: False, 10: True}


def test_the_verdict_of_the_query_goes_beyond_the_base_rules(spark):
    """With production parameters: lines are frequent on real tables and deplete documents."""
    got = quality.op8_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.n_frequent_words > 0).sum() > 0
    rows = host_rows(60, "x") + host_rows(600, "y")
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("NOT base_failed").collect()}
    assert {i for i, k in kept.items() if not k} == {60_000, 600_000}


def host_rows(size, host):
    """A tenth of the host's documents hold a line; the first of them has too few words besides."""
    line = "all rights reserved by the owners of this very host of pages"
    own = lambda i: " ".join(f"{host}{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abcdefghijkl")
    return [(1000 * size + i, (line + "\n" if i < size // 10 else "") + (own(i) if i else "few words of it"), host) for i in range(size)]


def test_depleted_documents_go_whatever_the_size_of_the_host(spark):
    rows = host_rows(60, "x") + host_rows(600, "y")
    got = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {i for i, _, _ in rows} - {r.doc_id for r in got} == {60_000, 600_000}


def test_frequent_lines_are_removed(spark):
    """Short ones too, and those that differ in digits; from each of repeated rows; at their host alone."""
    own = lambda i: " ".join(f"w{chr(97 + i)}{c}" for c in "abcdefghijklmnop")
    rows = [(i, f"Page {i}\n{own(i)}\n\n next >> \n{own(i)[::-1]}", "h") for i in range(8)]
    rows += [rows[0], (30, f"Page 1\n{own(20)}", "other"), (*rows[1][:2], "other"), (40, f"Page 9\n{own(21)[:44]}\nnext >>", "h")]
    got = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [(i, f"{own(i)}\n\n{own(i)[::-1]}", "h") for i in [*range(8), 0]] + [rows[9], rows[10], (40, own(21)[:44], "h")]
    assert sorted(map(tuple, got)) == sorted(want)


def rows_shuffled(df, column):
    """Rows with this column that df's exchanges write."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() in ("AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            return walk(node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan())
        if node.nodeName() == "Exchange" and any(node.output().apply(i).name() == column for i in range(node.output().size())):
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(found)


@pytest.fixture
def no_broadcast(spark):
    """As at sizes where what is found is too large to be broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_that_stay_as_they_are_are_not_shuffled(spark, no_broadcast):
    """Those of rejected and cut documents alone move, and copies' texts alone in near-dedup."""
    letters = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    rows = [(i, " ".join(letters(1000 * i + j) for j in range(25)), "h") for i in range(400)] + [(i, "short", "h") for i in range(400, 412)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = quality.keep_good(docs)
    assert rows_shuffled(good, "text") < 50
    assert sorted(map(tuple, good.collect())) == rows[:400]
    copies = [(i + 1000, rows[i][1] + " more", "h") for i in range(9)]
    one = near_dedup.keep_one(spark.createDataFrame(rows[:400] + copies, docs.schema))
    assert rows_shuffled(one, "text") < 50
    assert sorted(map(tuple, one.collect())) == rows[:400]


@pytest.mark.parametrize("bits", [24, 4])
def test_join_few_is_a_join(spark, monkeypatch, bits):
    """Also where the bit map is too small to rule out anything."""
    monkeypatch.setattr(common, "MAP_BITS", bits)
    rows = spark.range(-1000, 1000).selectExpr("id % 700 as k", "id as v")
    few = spark.createDataFrame([(k, k * 2) for k in range(-30, 2000, 10)], "k long, w long")
    for table in (few, few.limit(0)):
        for how in ("left", "left_anti", "inner"):
            got, want = common.join_few(rows, table, "k", how), rows.join(table, "k", how)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), how


# ---- 9


def test_near_dedup(spark, awkward, repeated, none, real):
    for df, rows in ((awkward, AWKWARD), (spark.createDataFrame(real, "doc_id long, text string"), real)):
        want = brute.near_components(rows)
        got = near_dedup.near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(brute.shingles(t)), want[i]) for i, t in rows}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    out = near_dedup.near_duplicates(repeated).collect()
    assert len(out) == repeated.count()
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_of_many_edited_copies(spark):
    """One original, copies with a few to many edits, and copies of copies: no link is lost in the large group."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base if i % 3 or i < 9 else rows[int(rng.integers(0, i))][1].split())
        for j in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[j] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    want = brute.near_components(rows)
    for how in (near_dedup.Sketch(), near_dedup.Sketch(broadcast_rows=0)):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_near_dedup_of_a_large_group(spark):
    """3,000 edited copies of one text, most of them near the threshold: all links are found, by few comparisons."""
    rng = np.random.default_rng(17)
    rows = []
    for i in range(3000):
        w = [f"w{j}" for j in range(150)]
        for j in rng.choice(150, 1 if i % 50 == 0 else int(rng.integers(4, 8)), replace=False):
            w[j] = f"x{rng.integers(0, 3000)}"
        rows.append((i, " ".join(w)))
    sets = [brute.shingles(t) for _, t in rows]
    names = {g: k for k, g in enumerate(set().union(*sets))}
    has = np.zeros((3000, len(names)), np.float32)
    for i, s in enumerate(sets):
        has[i, [names[g] for g in s]] = 1
    same, size = has @ has.T, has.sum(1)
    linked = 100 * same >= 75 * (size[:, None] + size[None, :] - same)
    label = np.arange(3000)
    while True:
        least = np.where(linked, label[None, :], 3000).min(1)
        if (least == label).all():
            break
        label = least
    calls, plain = [], near_dedup.compare

    def counted(pairs, *a, **k):
        calls.append(pairs.count())
        return plain(pairs, *a, **k)

    near_dedup.compare = counted
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        near_dedup.compare = plain
    assert got == {i: int(c) for i, c in enumerate(label)}
    assert sum(calls) < 20 * 3000, calls


def test_members_that_are_nobodys_best_count_as_owners(spark):
    """3 is compared with none and nobody's best: 1, which shares all of its set with it, isn't closed; 5 shares too little."""
    sets = {1: range(20), 2: range(10), 3: range(20), 4: range(90, 110), 5: range(100, 120)}
    table = spark.createDataFrame([(i, None, np.array(x, np.uint64).tobytes()) for i, x in sets.items()], "id long, registers binary, payload binary")
    rows = [(a, b, False, 20, 10, sorted(set(sets[a]) - set(sets[b]))) for a, b in ((1, 2), (5, 4))]
    compared = spark.createDataFrame(rows, near_dedup.PAIR)
    assert [r.id for r in near_dedup.closed(compared, table, near_dedup.Sketch()).collect()] == [5]


def test_one_row_of_repeated_ones_stays(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("a")), (2, text("a") + " more"), (3, text("b")), (None, text("b")), (None, text("c")), (None, text("c")), (None, text("c") + " more"), (4, ""), (4, ""), (5, text("d")), (5, text("e"))]
    got = [tuple(r) for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    c = [t for i, t in got if i is None]
    assert len(c) == 1 and c[0] in (text("c"), text("c") + " more")
    assert sorted(x for x in got if x[0]) == [(1, text("a")), (3, text("b")), (4, ""), (5, text("d")), (5, text("e"))]


def test_near_dedup_leaves_no_registers_and_sets(spark, real):
    """What no later step reads is deleted: most of what is written."""
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = near_dedup.near_duplicates(spark.createDataFrame(real, "doc_id long, text string"))
    left = {p.rsplit("-", 1)[0] for p in set(os.listdir(folder)) - before}
    assert "membership" in left and not left & {"sketch", "classes", "sets", "compared", "differences"}
    assert got.count() == len(real)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.75, 0.95):
        both = rng.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 1000 - len(both) // 2).astype(np.uint64)]) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert near_dedup.estimate(near_dedup.registers(a, 2000), near_dedup.registers(b, 2000)) == pytest.approx(true, abs=0.06)


# ---- 10


@pytest.mark.parametrize("batches", [1, 6])
def test_line_dedup(spark, awkward, batches):
    want = brute.drop_lines(AWKWARD)
    got = line_dedup.drop_lines(awkward, batches=batches, fanout=2).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got} == {i: (len(a), len(a) - len(b), "\n".join(b)) for i, (a, b) in want.items()}


def test_line_runs_are_levelled(spark, awkward, repeated, none):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for _ in range(5):
        runs.add(awkward.where("doc_id > 9").select("doc_id", "text"))
    assert sorted(r.level for r in runs.runs) == [0, 2]
    assert not runs.runs[-1].rows.where("is_new").count()  # what a later batch repeats isn't new
    assert line_dedup.drop_lines(repeated).count() == repeated.count()
    assert line_dedup.drop_lines(none).count() == 0
