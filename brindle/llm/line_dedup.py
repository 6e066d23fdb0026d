"""Line deduplication with levelled sorted runs of line hashes.

The store keeps what is known of lines as runs: tables sorted by the 128-bit hash of a line's
key, each row with the number of documents that hold it and the largest of their ids. A batch of
documents is reduced to one such row a line; those rows are merge-joined with the runs (both
sides sorted on the hash): what anti-joins is new, the rest adds to known lines. The batch then
becomes a run of level 0. When a level has ``fanout`` runs, they are compacted into one of the
next level, so a store of n batches has O(log n) runs and a row is rewritten O(log n) times.

Every run is a Parquet table in the shared folder: a lost executor loses nothing. Lines are
summed up in each task before they are shuffled, so a line that a third of the documents hold is
one row a task.

Defined results: a null or empty text is one empty line; a line counts once in a document,
however often it stands there; rows that share a doc_id are one document for counting, and each
is rewritten by itself; null ids count as one document, smaller than all others; an empty table
gives an empty one; other columns pass through, but for _row and _gone, which are dropped, and those that
the operator gives, which are replaced.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, ascii_lower, materialize, row_key, text_or_empty

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: _row, doc_id, line number, h1, h2."""
    at = F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("n", "line")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("_row"), at)
    keys = keys.select("doc_id", "_row", "n", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "_row", "n", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


@dataclass
class Run:
    level: int
    rows: DataFrame


@dataclass
class LineRuns:
    """The levelled store."""

    spark: SparkSession
    fanout: int = 4
    runs: list[Run] = field(default_factory=list)

    def _sorted_run(self, df: DataFrame, level: int) -> None:
        self.runs.append(Run(level, materialize(df.sortWithinPartitions(*HASH), f"line-run-{level}")))

    def add(self, docs: DataFrame, min_chars: int = 20) -> None:
        """One batch: its line rows, merge-joined with the runs, as a new run."""
        batch = _lines(docs, min_chars).groupBy(*HASH, "doc_id").agg(F.lit(1).alias("one"))
        batch = batch.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if self.runs:
            seen = functools.reduce(DataFrame.unionByName, [r.rows.select(*HASH) for r in self.runs])
            batch = batch.hint("merge").join(seen.distinct().withColumn("_seen", F.lit(True)), HASH, "left")
            batch = batch.withColumn("is_new", F.col("_seen").isNull()).drop("_seen")
        else:
            batch = batch.withColumn("is_new", F.lit(True))
        self._sorted_run(batch, 0)
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= self.fanout:
            self.runs = [r for r in self.runs if r.level != level]
            self._sorted_run(self._merged(full), level + 1)
            level += 1

    def _merged(self, runs: list[Run]) -> DataFrame:
        rows = functools.reduce(DataFrame.unionByName, [r.rows for r in runs])
        return rows.groupBy(*HASH).agg(
            F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.max("is_new").alias("is_new")
        )

    def lines(self) -> DataFrame:
        """What is known of every line: h1, h2, n_docs, last_doc."""
        return (self._merged(self.runs) if len(self.runs) > 1 else self.runs[0].rows).drop("is_new")


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4) -> DataFrame:
    """docs with their text without the lines that at least min_docs documents hold, but for the last of them.

    Adds n_lines (before) and n_dropped. batches: parts of the documents, cut by id, that are added one
    after the other; the result doesn't depend on it.
    """
    docs = docs.drop("_row", "_gone")
    runs = LineRuns(docs.sparkSession, fanout)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for i in range(batches):
        runs.add(docs.where(part == i) if batches > 1 else docs, min_chars)
    common = runs.lines().where(F.col("n_docs") >= min_docs)
    gone = (
        _lines(docs, min_chars)
        .join(common, HASH)
        .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy("_row")
        .agg(F.collect_set("n").alias("_gone"))
    )
    lines = F.split(text_or_empty(), "\n", -1)
    marked = docs.withColumn("_row", row_key()).join(gone, "_row", "left")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("_gone", i))
    return (
        marked.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
        .drop("_row", "_gone")
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM d),
k AS (SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, n, line, c.key IS NOT NULL AND k.doc_id <> last_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
