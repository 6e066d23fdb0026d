"""Relational helpers: keyset pages, latest row per key, log replay, key ranges, histogram percentiles, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n rows of the highest score; the smaller key first among equals."""
    return df.orderBy(F.desc_nulls_last(score), F.asc_nulls_last(key)).limit(n)


def page_after(df: DataFrame, score: str, key: str, n: int, after: tuple | None = None) -> DataFrame:
    """One page of top(): n rows strictly after the (score, key) that ended the page before."""
    if after is not None:
        s, k = after
        df = df.where((F.col(score) < s) | ((F.col(score) == s) & (F.col(key) > k)))
    return top(df, score, key, n)


def page_totals(df: DataFrame, score: str) -> DataFrame:
    """total_hits and max_score of all pages."""
    return df.agg(F.count(F.lit(1)).alias("total_hits"), F.max(score).alias("max_score"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order.

    An aggregate, not a window: maxima are taken in each task, so a key with very many rows is shuffled as a few.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last")
    out = df.groupBy(*keys).agg(last)
    return out.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns])


def replayed(log: DataFrame, keys: list[str], lsn: str, deleted: str, after: int | None = None, up_to: int | None = None) -> DataFrame:
    """The state that a log of puts and deletes leaves: the last put of each key in (after, up_to] that no delete follows."""
    if after is not None:
        log = log.where(F.col(lsn) > after)
    if up_to is not None:
        log = log.where(F.col(lsn) <= up_to)
    return latest(log, keys, [lsn]).where(~F.col(deleted)).drop(deleted)


def compacted(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sorted runs, oldest first, merged to one: the newest run's row of each key, sorted by key inside partitions."""
    all_of = runs[0].withColumn("_run", F.lit(0))
    for i, r in enumerate(runs[1:], 1):
        all_of = all_of.unionByName(r.withColumn("_run", F.lit(i)))
    return latest(all_of, keys, ["_run"]).drop("_run").sortWithinPartitions(*keys)


def key_range(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Rows with start <= key < end; the bounds reach the scan and skip row groups of a table sorted by key."""
    if start is not None:
        df = df.where(F.col(key) >= start)
    if end is not None:
        df = df.where(F.col(key) < end)
    return df


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """upper and n of each bucket; the last, for larger values, has no upper bound. One pass, one row."""
    edges = [float("-inf"), *map(float, bounds)]
    v = F.col(value)
    counts = [F.count_if((v > lo) & (v <= hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    one = df.agg(*counts, F.count_if(v > edges[-1]).alias("over"))
    rows = [F.struct(F.lit(float(u)).alias("upper"), F.col(f"b{i}").alias("n")) for i, u in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("upper"), F.col("over").alias("n")))
    return one.select(F.inline(F.array(*rows)))


def histogram_percentile(df: DataFrame, value: str, bounds: list[float], percent: int) -> DataFrame:
    """The upper bound of the bucket that holds the ceil(n * percent / 100)-th value; null where that is the unbounded one."""
    v = F.col(value)
    at_most = [F.count_if(v <= float(u)).alias(f"c{i}") for i, u in enumerate(bounds)]
    one = df.agg(F.count(v).alias("n"), *at_most)
    target = F.ceil(F.col("n") * percent / 100)
    hit = [F.when((F.col("n") > 0) & (F.col(f"c{i}") >= target), F.lit(float(u))) for i, u in enumerate(bounds)]
    return one.select(F.coalesce(*hit).alias("percentile"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Extension: to each left row the value of the last right row of its key at or before its time.

    Both sides are one union sorted by key and time, so the join costs one shuffle and no pairs. Keys are
    spread over the hash of the key; a key's rows are streamed, not held.
    """
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    b = right.select(*keys, time, F.col(value).alias("_v")).withColumn("_left", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(time, "_left").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left = 1").drop("_v", "_left")
