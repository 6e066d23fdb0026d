"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (a, b); others are their own.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes: O(log^2 n)
    steps whatever the shape. Minima are taken per task before the shuffle, and the joins that
    follow may be split where an id has very many links.
    """
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = links.where(F.col("a") != F.col("b")).select(*ordered(F.col("a"), F.col("b"))).distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(rounds):
        # Large star: every neighbour larger than u is linked to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        star = both.select(F.col("a").alias("u"), F.col("b").alias("v")).where(F.col("v") > F.col("u")).join(least, "u")
        large = star.select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # Small star: u (the larger end) and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        edges = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("the components didn't settle")
