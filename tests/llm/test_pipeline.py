"""The pipeline, stage by stage, against plain Python; and the registered oracles."""

import collections
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.llm import registry
from brindle.llm.common import materialize
from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, state = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), "test")
        if name == "quality_rules":
            state = {i: t for i, t in state.items() if not brute.base_failed(t)[0]}
        elif name == "line_dedup":
            state = {i: "\n".join(kept) for i, (_, kept) in brute.drop_lines(list(state.items())).items()}
        elif name == "near_dedup":
            first = brute.near_components(list(state.items()))
            state = {i: t for i, t in state.items() if first[i] == i}
        elif name == "decontaminate":
            state = {i: t for i, t in state.items() if not brute.leaks(t, items)}
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == state, name
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    by = collections.defaultdict(list)
    for r in docs.collect():
        by[r.doc_id].append(r)
    assert set(by) == set(state)
    assert all(sum(r.length for r in rows) == rows[0].doc_tokens for rows in by.values())
    whole = {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert whole == {(i, rows[0].doc_tokens) for i, rows in by.items()}


def test_stages_with_odd_tables(spark):
    """Null texts and ids, repeated rows, no rows, and columns with names that the operators use."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("a")), (2, None), (3, ""), (None, text("b")), (None, text("b")), (4, " ".join(f"c{i}" for i in range(8000))), (5, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("_row", "_gone", "_kept", "_id", "n_lines", "n_dropped", "loss_from", "h1", "item_id", "n", "start", "kept", "other0", "len", "w")
    docs = docs.withColumns({c: F.lit(f"<{c}>") for c in clashing})
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, DIR), "test")
            if name != "packing":
                assert now.columns == docs.columns, name
                assert all(r[c] == f"<{c}>" for r in now.collect() for c in clashing), name
        assert {r.doc_id for r in now.collect()} == ({1, None, 4, 5} if table is docs else set())
        assert now.where("start = 0").count() == (4 if table is docs else 0)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = registry.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(cols)
    norm = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(([norm(r[c]) for c in cols] for r in got.collect()), key=key) == sorted(([norm(v) for v in r] for r in cur.fetchall()), key=key)
