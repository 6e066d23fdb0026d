"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window of a document has as many words as the item it may leak. Windows and items get 256-bit
SimHash fingerprints of their words, each weighted by its multiplicity. Fingerprints are
looked up in a multi-index of 32 blocks of 8 bits: two fingerprints that differ in at most 31 bits agree in at least
one block, so the lookup gives every item within that radius. It gives most of those beyond it, too: what is
similar enough differs in 10 to 16 per cent of the bits, which leaves no block in common with a
probability of 1e-4 or less, and what shares a block by chance mostly differs in more than ``reach`` bits. Candidates are verified by the exact
weighted Jaccard similarity of their word shingles.

Only windows that can reach the threshold are made. Such a window shares at least the threshold's
part of an item's shingles, so positions are first joined with the items' shingles, and pairs of
document and item with too few are dropped. The start that fits best lies between two
neighbouring diagonals (position here less position there) of shared shingles: further out, moving
closer loses no shared shingle. Nothing is lost by either step. Which items a window is compared with is found by its
fingerprint alone.

The items' shingles go to the executors as a broadcast only while there are at most ``broadcast_shingles`` of
them (24 bytes each), else they are joined by a shuffle.

Defined results: null or empty texts and items match nothing; a document shorter than an item is
one window; items of fewer than ``k`` words are matched as one shingle of all their words; repeated
rows get the same result; items are told apart by id and text, so texts that share an id, or have none, are all
searched for (n_items counts ids, no id as one of them; item_id is null where only items without one match); an empty table or benchmark gives no matches; other columns pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize, row_key, words

#: Fingerprints are WORDS longs, looked up by blocks of BLOCK bits.
WORDS, BLOCK = 4, 8


def _grams(w: Column, k: int) -> Column:
    n = F.size(w)
    starts = F.sequence(F.lit(1), n - (k - 1))
    return F.when(n >= k, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, keys: list[str], words_of: str) -> DataFrame:
    """keys and fp (WORDS longs), the SimHash of the words in an array column, of each row of df.

    A bit is set that is set in the hashes of more than half of the words. Counted within the row by a small expression: spelling
    out the bits makes plans that the driver pays for.
    """
    hashes = [F.expr(f"transform({words_of}, x -> xxhash64({k}, x)) AS _h{k}") for k in range(WORDS)]
    bit = "IF(2 * size(filter(_h{k}, x -> getbit(x, j) = 1)) > size(_h{k}), shiftleft(1L, j), 0L)"
    longs = [f"aggregate(sequence(0, 63), 0L, (bits, j) -> bits | {bit.format(k=k)})" for k in range(WORDS)]
    return df.select(*keys, *hashes).select(*keys, F.expr(f"array({', '.join(longs)}) AS fp"))


def _blocks(fp: str) -> Column:
    """An array of (block, value) as one number: blocks of BLOCK bits that cover all bits."""
    per, every = 64 // BLOCK, (1 << BLOCK) - 1
    value = f"shiftrightunsigned({fp}[n DIV {per}], CAST({BLOCK} * (n % {per}) AS INT)) & {every}L"
    return F.expr(f"transform(sequence(0, {WORDS * per - 1}), n -> ({value}) | shiftleft(CAST(n AS BIGINT), {BLOCK}))")


def _distance(a: str, b: str) -> Column:
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(WORDS)])


def _common(a: str, b: str) -> Column:
    """Sum of the smaller multiplicities of the values of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    several = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(count(F.col(a), x), count(F.col(b), x)))
    return F.when(once, F.size(F.array_intersect(a, b))).otherwise(several)


def candidates(windows: DataFrame, items: DataFrame, reach: int = 90) -> DataFrame:
    """_row, len, start, _item of windows (_row, len, start, w) and items (_item, len, w) whose fingerprints share a block and differ in at most reach bits."""
    # Written once, as each fingerprint is looked up by all of its blocks.
    index = materialize(fingerprints(items, ["_item", "len"], "w").withColumnRenamed("fp", "item_fp"), "item-fingerprints")
    probe = materialize(fingerprints(windows, ["_row", "len", "start"], "w"), "fingerprints")
    index, probe = index.withColumn("block", F.explode(_blocks("item_fp"))), probe.withColumn("block", F.explode(_blocks("fp")))
    near = probe.join(index, ["len", "block"]).where(_distance("fp", "item_fp") <= reach)
    return near.select("_row", "len", "start", "_item").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75, reach: int = 90, broadcast_shingles: int = 1_000_000) -> DataFrame:
    """_row, item_id, start (word, from 1), n_words, similarity of the verified windows of docs (doc_id, text)."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.xxhash64("item_id", "text").alias("_item"), "item_id", words(F.lower("text")).alias("w"))
    items = items.withColumn("len", F.size("w")).where(F.col("len") > 0).withColumn("k", F.least(F.lit(k), F.col("len")))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most k numbers
    gram_of = functools.reduce(lambda e, s: F.when(F.col("k") == s, _grams(F.col("w"), s)).otherwise(e), sizes, F.array().cast("array<bigint>"))
    items = materialize(items.select("_item", "item_id", "len", "k", "w", gram_of.alias("ig")).dropDuplicates(["_item"]), "items")
    small = (items.agg(F.sum(F.size("ig"))).head()[0] or 0) <= broadcast_shingles
    shingles = items.select("_item", "len", "k", F.posexplode("ig").alias("ipos", "g"))

    src = docs.select(row_key().alias("_row"), words(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
    hits = []
    for s in sizes:
        at = src.select("_row", F.size("w").alias("n"), F.posexplode(_grams(F.col("w"), s)).alias("pos", "g"))
        of_items = shingles.where(F.col("k") == s).drop("k")
        hits.append(at.join(F.broadcast(of_items) if small else of_items, "g").withColumn("k", F.lit(s)))
    if not hits:
        item_id = dict(benchmark.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame([], f"_row struct<a:long,b:long>, item_id {item_id}, start int, n_words int, similarity double")
    hits = functools.reduce(DataFrame.unionByName, hits)
    per = hits.groupBy("_row", "_item", "len", "k", "n").agg(
        F.size(F.collect_set("ipos")).alias("found"), F.sort_array(F.collect_set(F.col("pos") - F.col("ipos"))).alias("diag")
    )
    per = per.where(100 * F.col("found") >= percent * (F.col("len") - F.col("k") + 1))
    # All starts from one diagonal to the next, if that is within an item's length; 0-based, then moved inside the text.
    inside = lambda d, i: F.sequence(d, F.least(F.coalesce(F.get("diag", i + 1), d), d + F.col("len")))
    starts = F.array_distinct(F.transform(F.flatten(F.transform("diag", inside)), lambda s: F.greatest(F.lit(0), F.least(s, F.col("n") - F.col("len")))))
    spots = per.select("_row", F.struct("len", "k", starts.alias("starts")).alias("spot")).groupBy("_row").agg(F.collect_set("spot").alias("spots"))
    # A table of known size: whether it is broadcast is left to Spark's own limit in bytes.
    here = src.join(materialize(spots, "spots"), "_row").select("_row", "w", F.explode("spots").alias("spot"))
    here = here.select("_row", "w", F.col("spot.len").alias("len"), F.col("spot.k").alias("k"), F.explode("spot.starts").alias("start"))
    part = here.select("_row", "len", "k", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("w")).dropDuplicates(["_row", "len", "start"])
    wgram = functools.reduce(lambda e, s: F.when(F.col("k") == s, _grams(F.col("w"), s)).otherwise(e), sizes, F.array().cast("array<bigint>"))
    windows = materialize(part.select("_row", "len", "start", "w", wgram.alias("wg")), "windows")

    both = candidates(windows, items, reach).join(windows.drop("w"), ["_row", "len", "start"]).join(items.select("_item", "item_id", "ig"), "_item")
    both = both.withColumn("same", _common("wg", "ig")).withColumn("all", F.size("wg") + F.size("ig") - F.col("same"))
    return both.where(100 * F.col("same") >= percent * F.col("all")).select(
        "_row", "item_id", (F.col("start") + 1).alias("start"), F.col("len").alias("n_words"), (F.col("same") / F.col("all")).alias("similarity")
    )


def judge(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (the most similar; the smallest of equals) and similarity of each document."""
    # The smallest of (-similarity, has no id, item_id), so ids may be of any type that has an order.
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("item_id").isNull().alias("no_id"), "item_id")).alias("best")
    found = matches(docs, benchmark, **how).groupBy("_row").agg((F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("int"))).alias("n_items"), best)
    out = docs.select("doc_id", row_key().alias("_row")).join(found, "_row", "left")
    return out.select(
        "doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("best.item_id").alias("item_id"),
        (-F.col("best.s")).alias("similarity"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a window like an item; the rest untouched."""
    leaking = materialize(matches(docs, benchmark, **how).select("_row").distinct(), "leaking")
    return docs.drop("_row").withColumn("_row", row_key()).join(leaking, "_row", "left_anti").drop("_row")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    return judge(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


#: All starts of all items that share a shingle with the document.
ORACLE = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ig AS (SELECT item_id, len(w) AS n, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM i WHERE len(w) >= 5)),
ic AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
dg AS (SELECT doc_id, len(w) AS dn, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, dn, p, item_id, n, c, g FROM dg JOIN ic USING (g)),
s AS (SELECT DISTINCT doc_id, item_id, n, dn, unnest(range(greatest(1, least(p - n + 5, dn - n + 1)), greatest(1, least(p, dn - n + 1)) + 1)) AS s FROM h),
m AS (SELECT s.doc_id, s.item_id, s.n, s.dn, s.s, h.g, least(count(*), any_value(h.c)) AS c FROM s JOIN h ON h.doc_id = s.doc_id AND h.item_id = s.item_id
  AND h.p BETWEEN s.s AND s.s + s.n - 5 GROUP BY s.doc_id, s.item_id, s.n, s.dn, s.s, h.g),
t AS (SELECT doc_id, item_id, s, sum(c) AS same, least(any_value(n), any_value(dn)) - 4 + any_value(n) - 4 - sum(c) AS every FROM m GROUP BY doc_id, item_id, s),
b AS (SELECT doc_id, item_id, max(same / every) AS similarity FROM t WHERE 100 * same >= 75 * every GROUP BY doc_id, item_id),
f AS (SELECT doc_id, count(*) AS n_items, max(similarity) AS similarity, arg_min(item_id, (-similarity, item_id)) AS item_id FROM b GROUP BY doc_id)
SELECT documents.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item_id, similarity FROM documents LEFT JOIN f USING (doc_id)
"""
