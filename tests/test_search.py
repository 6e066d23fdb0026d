import math

import pytest
from pyspark.sql import functions as F

from brindle.operators import search as S

DOCS = [(1, "apple pie", "fruit", 3), (2, "apple juice is good", "fruit", 5), (3, "pie crust", "dough", 10), (4, "", None, None), (5, None, "x", 7)]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, body string, kind string, price long")
    return S.build(docs, ["body", "kind"], ["price"])


def ids(index, q, **k):
    return [r.doc_id for r in S.search(index, q, **k).collect()]


def test_boolean_set(index):
    assert ids(index, "apple pie") == [1]
    assert set(ids(index, "apple OR pie")) == {1, 2, 3}
    assert ids(index, "apple -pie") == [2]
    assert ids(index, "NOT apple") == [3, 4, 5]
    assert ids(index, "-apple -pie") == []
    assert set(ids(index, "(apple AND juice) OR crust")) == {2, 3}
    assert ids(index, "*") == [1, 2, 3, 4, 5] and ids(index, "") == [1, 2, 3, 4, 5]


def test_other_queries(index):
    assert ids(index, "kind:dough") == [3]
    assert set(ids(index, "app*")) == {1, 2}
    assert set(ids(index, "aple~1")) == {1, 2}
    assert ids(index, '"apple pie"') == [1] and ids(index, '"pie apple"') == []
    assert ids(index, '"juice is good"') == [2]  # the stop word leaves its place open
    assert ids(index, "price:[3 TO 5]") == [1, 2] and ids(index, "price:{3 TO 7}") == [2]
    for bad in ("(apple", "apple)", "AND", "[1 TO 2]", "title:[1 TO", "price:{3 TO", "price:3]"):
        with pytest.raises(S.QueryError):
            S.parse(bad)


def test_scores_and_pages(spark, index):
    lengths = {1: 2, 2: 3, 3: 2}
    average = sum(lengths.values()) / 3
    n, df = 5, 2
    want = {i: math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[i] / average)) for i in (1, 2)}
    got = {r.doc_id: r.score for r in S.search(index, "body:apple").collect()}
    assert got == pytest.approx(want)
    first = S.search(index, "apple OR pie", 1).head()
    rest = ids(index, "apple OR pie", after=(first.score, first.doc_id))
    assert first.doc_id not in rest and len(rest) == 2
    assert S.totals(index, "apple OR pie").head().total_hits == 3


def test_phrase_scored_by_all_terms(index):
    row = S.search(index, 'body:"apple pie"').head()
    average = 7 / 3
    want = math.log((5 - 1 + 0.5) / 1.5 + 1) * (2 * 2.2) / (2 + 1.2 * (0.25 + 0.75 * 2 / average))
    assert row.score == pytest.approx(want)


def test_updates_facets_stats(spark, index):
    new = S.build(spark.createDataFrame([(2, "pear", "tree", 1)], "doc_id long, body string, kind string, price long"), ["body", "kind"], ["price"])
    after = index.merged(new)
    assert ids(after, "apple") == [1] and ids(after, "pear") == [2]
    assert ids(index.without(spark.createDataFrame([(1,)], "doc_id long")), "apple") == [2]
    docs = spark.createDataFrame(DOCS, "doc_id long, body string, kind string, price long")
    assert [tuple(r) for r in S.faceted(index, docs, "apple OR pie", "kind", 5).collect()] == [("fruit", 2), ("dough", 1)]
    assert index.stats().head().docs == 5
    assert [r.term for r in S.suggestions(index, "cr").collect()] == ["crust"]


def test_analysis(spark):
    assert S.tokenize("Don't stop, O.K.! - x_1") == [("don't", 0), ("stop", 1), ("o.k", 2), ("x_1", 3)]
    assert S.analyze("the running cats") == [("run", 1), ("cat", 2)]
    df = spark.createDataFrame([("The  Cat sat",), (None,)], "t string").select(S.whitespace_tokens("t").alias("w"))
    assert df.head().w == ["the", "cat", "sat"]
    assert [tuple(x) for x in df.select(S.without_stop_words("w").alias("x")).head().x] == [("cat", 1), ("sat", 2)]


def test_highlight(spark):
    assert S.highlight("An apple a day", ["apple", "day"]) == ["An **apple** a **day**"]
    assert S.highlight("x" * 300, ["q"], 10) == ["x" * 10 + "..."]
    long = "a " * 100 + "needle" + " b" * 100
    (only,) = S.highlight(long, ["NEEDLE"], 30)
    assert only.startswith("...") and only.endswith("...") and "**needle**" in only
    df = spark.createDataFrame([("red fox",), (None,)], "t string")
    assert [r.snippets for r in S.with_highlights(df, "t", "fox AND red").collect()] == [["**red** **fox**"], []]


def test_symbols_have_positions():
    """Unicode's default word bounds; other symbols than ASCII punctuation are tokens."""
    assert S.tokenize("a “b” → c.d 3.14 x.1") == [(t, i) for i, t in enumerate(["a", "“", "b", "”", "→", "c.d", "3.14", "x", "1"])]
    assert [t for t, _ in S.tokenize("日本語 テキスト e-mail")] == ["日", "本", "語", "テキスト", "e", "mail"]


def test_stored_indexes(spark, index, tmp_path):
    store = S.IndexStore(spark, f"file://{tmp_path}/indexes")
    assert store.names() == []
    kept = store.save("fruit", index)
    assert store.names() == ["fruit"] and ids(kept, "apple OR pie") == ids(index, "apple OR pie")
    assert ids(store.open("fruit"), '"apple pie"') == [1] and ids(store.open("fruit"), "price:[3 TO 5]") == [1, 2]
    with pytest.raises(ValueError):
        store.save("fruit", index)
    store.drop("fruit")
    with pytest.raises(ValueError):
        store.open("fruit")


def test_terms_are_counted_within_the_row(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>").select(S.term_counts(F.col("t")).alias("x"))
    assert [[tuple(y) for y in r.x] for r in df.collect()] == [[("a", 1), ("b", 2)], []]


def test_analysis_hands_on_bounded_batches():
    """A worker holds the postings of some texts, not of a batch, and chunks and terms are those of analyze()."""
    import pyarrow as pa

    texts = [" ".join(f"w{i * 300 + k}x and," for k in range(300)) for i in range(400)] + ["", None, "the", "x ́a ‍b", "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["t"] * len(texts)), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["field", "doc_id", "text"])
    sizes, got, lengths = [], {}, {}
    for out in S.posting_batches([batch]):
        sizes.append(sum(map(len, out.column("p").to_pylist())))
        for r in out.to_pylist():
            got[r["doc_id"]], lengths[r["doc_id"]] = [(p["term"], i) for p in r["p"] for i in p["positions"]], r["len"]
    assert sum(sizes) >= 120_000 and max(sizes) < S.HELD + 300
    want = {i: S.analyze(t) for i, t in enumerate(texts) if t}
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items() if x}
    assert {r["doc_id"]: r["len"] for out in S.length_batches([batch]) for r in out.to_pylist()} == lengths


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries whose plan may analyze the texts once at most; they analyzed all texts in every branch, a batch at a time.
ONCE = "field_lengths search_term search_and_not search_fuzzy search_not search_or search_page search_totals search_phrase search_stats search_facets search_prefix".split()


@pytest.mark.parametrize("name", ONCE)
def test_texts_are_analyzed_once_in_small_batches(spark, name):
    import __spark_entry__

    plan = _plan(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython") == 0 and plan.count("MapInArrow") <= 1


def test_stored_index_is_written_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} common x{i}") for i in range(200)] + [(900, None), (901, "the")], "doc_id long, body string")
    kept = S.IndexStore(spark, f"file://{tmp_path}/i").save("i", S.build(docs, ["body"]))
    assert kept.lengths.count() == 200 and kept.stats().head().tokens == 600
    assert [r.n for r in kept.postings.groupBy("term").count().where("term = 'common'").select(F.col("count").alias("n")).collect()] == [200]
    assert not (tmp_path / "i" / "i" / "lengths").exists()
    again = S.IndexStore(spark, f"file://{tmp_path}/i").save("j", kept)
    assert ids(again, "w3") == ids(kept, "w3") and again.stats().head() == kept.stats().head()
