"""Search queries of the catalogue: all go through an index and the query language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.catalog import query
from brindle.operators import search
from brindle.session import scratch_dir, table

_STOPS = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
#: The standard tokenizer and the index in SQL; letters and digits part at a dot between them.
_TOKENS = rf"""
WITH parted AS (SELECT doc_id, regexp_replace(regexp_replace(lower(nfc_normalize(text)), '(\p{{L}})[.:''’](\p{{N}})', '\1 \2', 'g'), '(\p{{N}})[.:''’](\p{{L}})', '\1 \2', 'g') AS t FROM documents),
raw AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+(?:[''’.:][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}\s\x00-\x7f]'), lambda x: trim(x, '_')), lambda x: x <> '') AS ts FROM parted),
tok AS (SELECT * FROM (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM raw) WHERE term NOT IN ({_STOPS})),
len AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(len) FROM len) AS al),
score AS (SELECT term, doc_id, ln((n-df+0.5)/(df+0.5)+1)*(tf*2.2)/(tf+1.2*(0.25+0.75*len/al)) AS s
  FROM (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2) JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1) USING (term) JOIN len USING (doc_id), st)
"""


def _index(spark: SparkSession, d: str) -> search.Index:
    return search.build(table(spark, d, "documents").select("doc_id", "text", "n_chars"), ["text"], ["n_chars"])


def _hits(spark: SparkSession, d: str, text: str) -> DataFrame:
    return search.found(_index(spark, d), text)


@query(_TOKENS + "SELECT doc_id, round(s, 6) AS score FROM score WHERE term = 'nicht'")
def search_term(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "nicht").select("doc_id", F.round("score", 6).alias("score"))


@query(_TOKENS + "SELECT doc_id, round(sum(s), 6) AS score FROM score WHERE term IN ('nicht', 'von', 'que') GROUP BY 1")
def search_or(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "nicht OR von OR text:que").select("doc_id", F.round("score", 6).alias("score"))


@query(
    _TOKENS + "SELECT a.doc_id, round(a.s + b.s, 6) AS score FROM score a JOIN score b ON a.doc_id = b.doc_id AND a.term = 'und' AND b.term = 'von'"
    " WHERE a.doc_id NOT IN (SELECT doc_id FROM tok WHERE term IN ('mit', 'auf'))"
)
def search_and_not(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "und AND von -mit NOT auf").select("doc_id", F.round("score", 6).alias("score"))


@query(_TOKENS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE term IN ('der', 'que'))")
def search_not(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "NOT (der OR que)").select("doc_id")


@query(_TOKENS + "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'und' AND b.term = 'der'")
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, '"und der"').select("doc_id")


@query(_TOKENS + "SELECT DISTINCT doc_id FROM tok WHERE starts_with(term, 'nic')")
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "nic*").select("doc_id")


@query(_TOKENS + "SELECT DISTINCT doc_id FROM tok WHERE levenshtein(term, 'für') <= 1")
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "für~1").select("doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 100 AND 900")
def search_range(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "n_chars:[100 TO 900]").select("doc_id")


@query(_TOKENS + "SELECT doc_id FROM (SELECT doc_id, sum(s) AS x FROM score WHERE term IN ('und', 'nicht') GROUP BY 1 ORDER BY x DESC, doc_id LIMIT 10 OFFSET 5)")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_index(spark, d), "und OR nicht", limit=10, offset=5).select("doc_id")


@query(_TOKENS + "SELECT CAST(count(*) AS BIGINT) AS total_hits, round(max(s), 6) AS max_score FROM score WHERE term = 'von'")
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return search.totals(_index(spark, d), "von").select("total_hits", F.round("max_score", 6).alias("max_score"))


@query(_TOKENS + "SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM tok WHERE term = 'it') GROUP BY 1")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    return search.faceted(_index(spark, d), table(spark, d, "documents"), "it", "lang", 100)


@query(_TOKENS + "SELECT n AS docs, CAST((SELECT sum(len) FROM len) AS BIGINT) AS tokens, CAST(1 AS BIGINT) AS fields FROM st")
def search_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats()


@query(_TOKENS + "SELECT doc_id, round(s, 6) AS score FROM score WHERE term = 'von' AND doc_id % 10 <> 3")
def search_stored(spark: SparkSession, d: str) -> DataFrame:
    """From an index kept under a name, after documents were deleted; scores stay as they were where they are not recounted."""
    store = search.IndexStore(spark, scratch_dir(spark))
    store.save("articles", _index(spark, d))
    hits = search.evaluate(store.open("articles"), search.parse("text:von"))
    return hits.where("doc_id % 10 <> 3").select("doc_id", F.round("score", 6).alias("score"))


@query(_TOKENS + "SELECT doc_id, CAST(len AS BIGINT) AS tokens FROM len")
def field_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).lengths.select("doc_id", F.col("len").alias("tokens"))
