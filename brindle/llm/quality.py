"""Quality rules from line frequencies across documents, in DataFrame functions only.

Lines are normalised (stripped, A-Z lower-cased, digits to 0) and hashed; for each host the
distinct documents that hold a line are counted, copies of a text as one, so copies of a clean page don't condemn each other. A line
is frequent if more than ``limit`` of them and more than ``percent`` per cent of the host's distinct documents
hold it: a share, so a page's verdict doesn't depend on the size of its host. Frequent lines
are removed, and a document of which fewer than ``min_words`` words are left is rejected as
depleted. Documents that fail the base rules are rejected before that. judge() counts the words of such
lines for the verdict; keep_good() gives the texts without them.

A line that a third of the documents hold is first reduced to one row a text, then summed in
each task, and the list of frequent lines goes to the lines by salted keys, so no task gets all of it; the lines themselves
never leave a task as text. What is removed is joined by document and line number; documents that keep all their lines
aren't shuffled for that, but for a few (join_few).

Defined results: a null text has no words and fails; repeated rows get the same verdict; null
hosts form one host; an empty table gives an empty one; other columns pass through unless the
operator gives one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, ascii_lower, join_few, join_hot, materialize, row_key, salts, text_or_empty, words

SYMBOLS = "#*$%&|<>"
#: What makes a line frequent: more than so many documents of its host, and than so many per cent of them.
FEW, PERCENT = 4, 5


def base_measures(docs: DataFrame, window: int = 5, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = text_or_empty()
    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    df = docs.withColumn("_w", words(text)).withColumn("_lines", with_word)
    n = F.size("_w")
    starts = F.sequence(F.lit(1), n - (window - 1))
    grams = F.when(n >= window, F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, window)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", grams).withColumn("_repeats", F.size("_g") > F.size(F.array_distinct("_g")))
    # (hash, position) in order: equal windows stand side by side.
    in_order = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_repeats"), in_order))
    same = lambda a, b: F.coalesce(F.try_element_at("_s", a)["h"] == F.try_element_at("_s", b)["h"], F.lit(False))
    last = F.size("_s")
    twice = F.filter(
        F.sequence(F.lit(1), last),
        lambda j: ((j > 1) & same(F.greatest(j - 1, F.lit(1)), j)) | ((j < last) & same(j, F.least(j + 1, last))),
    )
    at = F.array_sort(F.transform(twice, lambda j: F.element_at("_s", j)["i"]))
    df = df.withColumn("_at", F.when(F.col("_repeats"), at))
    covered: Column = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("to")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["to"])).alias("n"), i.alias("to")),
        lambda a: a["n"],
    )
    repeat = F.when(F.col("_repeats"), covered).otherwise(F.lit(0))
    return (
        df.withColumns(
            {
                "n_words": n.cast("long"),
                "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeat.cast("long"),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
        .drop("_w", "_lines", "_g", "_repeats", "_s", "_at")
    )


def _key(host: str) -> Column:
    """As row_key(), but rows that differ in their host alone have other frequent lines."""
    return row_key("doc_id", "text", host)


def frequent_lines(docs: DataFrame, host: str = "source", limit: int = FEW, percent: int = PERCENT) -> DataFrame:
    """_row, n_frequent_words and _gone (line numbers from 0), of documents with lines that more than limit different texts of their host, and percent of them, hold."""
    lines = docs.select(_key(host).alias("_row"), F.xxhash64(text_or_empty()).alias("_text"), F.xxhash64(host).alias("_host"), text_or_empty().alias("_t"))
    texts = lines.groupBy("_host", "_text").agg(F.lit(1).alias("one")).groupBy("_host").agg(F.count(F.lit(1)).alias("_of"))
    lines = lines.select("_row", "_text", "_host", F.posexplode(F.split("_t", "\n", -1)).alias("_at", "_line"))
    bare = F.btrim(F.col("_line"), F.lit(SPACES))
    lines = lines.select(
        "_row",
        "_text",
        "_host",
        "_at",
        F.xxhash64("_host", F.translate(ascii_lower(bare), "123456789", "000000000")).alias("_h"),
        F.size(words(F.col("_line"))).alias("_n"),
    ).where(F.col("_n") > 0)
    lines = materialize(lines, "lines")  # hashes and numbers; the texts are read once for them
    common = lines.groupBy("_h", "_host", "_text").agg(salts("_row")).groupBy("_h", "_host").agg(F.count(F.lit(1)).alias("n"), F.bit_or("_salts").alias("_salts"))
    common = common.where(F.col("n") > limit)
    if percent:
        common = common.join(texts, "_host").where(100 * F.col("n") > percent * F.col("_of"))
    common = materialize(common.select("_h", "_salts"), "frequent-lines")
    found = join_hot(lines.select("_row", "_h", "_at", "_n"), common, ["_h"], "_row").groupBy("_row", "_at").agg(F.first("_n").alias("_n"))
    return found.groupBy("_row").agg(F.sum("_n").alias("n_frequent_words"), F.collect_set("_at").alias("_gone"))


def _judged(docs: DataFrame, frequent: DataFrame, host: str, min_words: int) -> DataFrame:
    """docs with the base measures, kept, and _row and the columns of frequent."""
    out = base_measures(docs.withColumn("_row", _key(host)), min_words=min_words)
    out = out.join(frequent, "_row", "left")
    out = out.withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_frequent_words") < min_words
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, host: str = "source", limit: int = FEW, min_words: int = 10, percent: int = PERCENT) -> DataFrame:
    """docs with the base measures, n_frequent_words and kept."""
    docs = docs.drop("_row", "n_frequent_words")
    return _judged(docs, frequent_lines(docs, host, limit, percent).drop("_gone"), host, min_words).drop("_row")


def keep_good(docs: DataFrame, host: str = "source", limit: int = FEW, min_words: int = 10, percent: int = PERCENT) -> DataFrame:
    """The documents that judge() keeps, their texts without the frequent lines; texts without such lines are untouched."""
    docs, own = docs.drop("_row", "_gone", "_kept"), docs.select("doc_id", "text", host)
    judged = _judged(own, frequent_lines(own, host, limit, percent), host, min_words)
    changed = judged.where(~F.col("kept") | F.col("_gone").isNotNull()).groupBy("_row").agg(F.first("kept").alias("_kept"), F.first("_gone").alias("_gone"))
    out = join_few(docs.withColumn("_row", _key(host)), materialize(changed, "rejected-or-cut"), "_row")
    left = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("_gone", i))
    out = out.where(F.coalesce("_kept", F.lit(True)))
    text = F.when(F.col("_gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    return out.withColumn("text", text).drop("_row", "_gone", "_kept")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
f AS (SELECT doc_id, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl FROM w),
g AS (SELECT doc_id, unnest(range(1, CAST(len(ws) - 3 AS BIGINT))) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM h) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(ls) AS line FROM w),
k AS (SELECT doc_id, source, t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS key FROM l),
s AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
c AS (SELECT k.source, key FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source WHERE n > 0 GROUP BY k.source, key, texts
  HAVING count(DISTINCT t) > 4 AND 100 * count(DISTINCT t) > 5 * texts),
q AS (SELECT k.doc_id, sum(n) AS n FROM k JOIN c ON k.key = c.key AND k.source IS NOT DISTINCT FROM c.source GROUP BY k.doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(fl) - len(list_distinct(fl)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(q.n, 0) AS BIGINT) AS n_frequent_words
  FROM w JOIN f USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_frequent_words >= 10 AS kept, n_frequent_words FROM b
"""
