"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` points on a ring of 64-bit hashes, and a key belongs to the first point
clockwise from its own. No shard takes more than (1 + slack) of the mean load: a key that finds
its shard full continues clockwise to the next shard with room. Keys are the groups of equal
texts, so copies lie together as long as their shard has room.

Keys are counted by cells, equal arcs of the ring. A cell whose load is large is cut into
sub-cells by another hash of the text, and a text that is large by itself into parts by the hash of
the document's id; its parts go to shards one by one only if the text has half of a shard's mean load or more, else they
stay together. Large keys are placed first, while there is room, the others in the order of the ring. The table of cell loads has a bound that doesn't
depend on the input (``cells``, plus ``split`` for each of the at most 8 * cells/split large cells and large texts),
so it is gathered, the ring is walked on the driver, and the table of placements goes back to
the documents as a broadcast of the same bound. A document's slot is the sum of the counts of the
cells before its own in its shard plus its rank in its cell, so no shard is ever sorted as a whole.

Defined results: a null text has the size 1 and the hash of an empty one; repeated rows and null
ids get slots of their own; an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import materialize


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """The points of all shards in order: (position, shard). A shard's points don't depend on how many others there are."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def place(cells: list[tuple[int, int, int, int]], shards: int, nodes: int, slack: float, width: int) -> list[int]:
    """The shard of each cell. cells: (cell, sub, rows, load) in ring order; width: positions in a cell.

    A cell that fits no shard within the bound goes to the one with the smallest load.
    """
    points = ring(shards, nodes)
    positions = [p for p, _ in points]
    limit = (1 + slack) * sum(c[3] for c in cells) / shards
    loads, out = [0] * shards, []
    for cell, _, _, load in cells:
        i = bisect.bisect_left(positions, cell * width)
        tried: set[int] = set()
        chosen = None
        while len(tried) < shards:
            s = points[i % len(points)][1]
            if s not in tried:
                if loads[s] + load <= limit:
                    chosen = s
                    break
                tried.add(s)
            i += 1
        if chosen is None:
            chosen = min(range(shards), key=lambda s: (loads[s], s))
        loads[chosen] += load
        out.append(chosen)
    return out


def shard(
    docs: DataFrame, shards: int = 8, nodes: int = 64, slack: float = 0.001, cells: int = 1 << 14, split: int = 256
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of docs (doc_id, text), balanced by size."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = cells.bit_length() - 1
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    ).withColumns(
        {
            "_cell": F.shiftrightunsigned("_key", 64 - bits).cast("int"),
            "_salt": F.pmod(F.xxhash64(F.lit(3), F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")), "_key"), F.lit(split)).cast("int"),
        }
    )
    rows = materialize(rows, "shard-rows")  # no text any more; read four times from here
    whole = rows.groupBy("_cell").agg(F.sum("size").alias("load"))
    total = whole.agg(F.sum("load")).head()[0] or 0
    # At most 8 * cells / split cells, and as many texts, can have this load or more.
    is_large = F.col("load") >= total / (8 * cells / split)
    large = [r[0] for r in whole.where(is_large).select("_cell").collect()] if total else []
    sub, hot, loads = F.lit(0), [], {}
    if large:
        inside = F.col("_cell").isin(large)
        texts = rows.where(inside).groupBy("_key").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).where(is_large & (F.col("n") > 1))
        of_text = -1 - F.pmod(F.xxhash64(F.lit(5), "_key"), F.lit(split)).cast("int")
        sub = F.when(inside, of_text).otherwise(sub)
        loads = {r[0]: r[1] for r in texts.select("_key", "load").collect()}
        if hot := sorted(loads):
            number = F.array_position(F.array(*map(F.lit, hot)), F.col("_key")).cast("int")
            sub = F.when(number > 0, number * split + F.col("_salt")).otherwise(sub)
    rows = rows.withColumn("_sub", sub)
    stats = rows.groupBy("_cell", "_sub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("load"))
    table = sorted(tuple(r) for r in stats.select("_cell", "_sub", "n", "load").collect())
    # The key that a sub-cell is placed with: a large text's parts have one if the text isn't too large.
    together = {i for i, k in enumerate(hot, 1) if 2 * shards * loads[k] < total}
    of_key: dict[tuple[int, int], int] = {}
    for cell, s, _, load in table:
        key = cell, s - s % split if s // split in together else s
        of_key[key] = of_key.get(key, 0) + load
    keys = sorted(((*k, 0, load) for k, load in of_key.items()), key=lambda k: (-k[3] if k[3] >= total / (8 * cells / split) else 0, k))
    to_shard = {k[:2]: to for k, to in zip(keys, place(keys, shards, nodes, slack, (1 << 64) // cells))}
    filled, placed = [0] * shards, []
    for cell, s, n, _ in table:
        to = to_shard[cell, s - s % split if s // split in together else s]
        placed.append((cell, s, to, filled[to]))
        filled[to] += n
    places = spark.createDataFrame(placed, "_cell int, _sub int, shard int, _before long")
    in_cell = W.partitionBy("_cell", "_sub").orderBy("_key", "doc_id", "size")
    return (
        rows.join(F.broadcast(places), ["_cell", "_sub"])
        .withColumn("slot", F.col("_before") + F.row_number().over(in_cell) - 1)
        .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal sizes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
