"""Content-addressed blobs: chunks, hashes, reference counts, verified and ranged reads, collection of garbage.

A blob is bytes: strings are taken as their UTF-8, sizes and offsets count bytes, and what is read back is binary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.merkle import merkle_root

NAMESPACE = r"^[\p{L}\p{N}._-]+$"


def _bytes(data: str) -> Column:
    return F.col(data).cast("binary")


def _joined(parts: Column) -> Column:
    """The bytes of an array of binaries put together."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def chunks(df: DataFrame, data: str, size: int) -> DataFrame:
    """df without data, exploded to chunk_no, chunk and its SHA-256; an empty value has one empty chunk."""
    df = df.withColumn(data, F.coalesce(_bytes(data), F.lit(b"")))  # once, as a substring of bytes takes the same time anywhere
    n = F.greatest(F.lit(1), F.ceil(F.length(data) / F.lit(float(size)))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(data), i * size + 1, F.lit(size)))
    out = df.select(*[c for c in df.columns if c != data], F.posexplode(parts).alias("chunk_no", "chunk"))
    return out.withColumn("chunk_no", F.col("chunk_no").cast("bigint")).withColumn("hash", F.sha2("chunk", 256))


def put(df: DataFrame, key: str, data: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(metadata, store): per blob its size, hash, Merkle root and chunk hashes in order; each different chunk once."""
    all_of = chunks(df.select(key, data), data, size)
    listed = all_of.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "hash"))).alias("c"), F.sum(F.length("chunk")).alias("size"))
    meta = listed.select(key, "size", F.transform("c", lambda x: x["hash"]).alias("chunk_hashes"))
    meta = meta.withColumn("merkle_root", merkle_root("chunk_hashes"))
    meta = meta.join(df.select(key, F.sha2(F.coalesce(_bytes(data), F.lit(b"")), 256).alias("content_hash")), key)
    return meta, all_of.groupBy("hash").agg(F.any_value("chunk").alias("chunk"))


def reference_counts(meta: DataFrame) -> DataFrame:
    """hash and refs over the chunk lists of live blobs."""
    return meta.select(F.explode("chunk_hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("refs"))


def download(meta: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """key, data and verified: chunks put together in order, whole and in parts as hashed."""
    at = meta.select(key, "content_hash", F.posexplode("chunk_hashes").alias("chunk_no", "hash")).join(store, "hash", "left")
    ok = F.coalesce(F.sha2("chunk", 256) == F.col("hash"), F.lit(False))
    whole = at.groupBy(key, "content_hash").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"), F.min(ok).alias("parts_ok"))
    whole = whole.withColumn("data", _joined(F.transform("c", lambda x: x["chunk"])))
    return whole.select(key, "data", (F.col("parts_ok") & (F.sha2("data", 256) == F.col("content_hash"))).alias("verified"))


def read_range(df: DataFrame, data: str, offset: int, length: int) -> DataFrame:
    """df with part: so much from offset, as far as there is any; rows that end before offset have none and go."""
    return df.withColumn(data, _bytes(data)).where(F.length(data) > offset).withColumn("part", F.substring(data, offset + 1, length)).drop(data)


def read_chunk_range(meta: DataFrame, store: DataFrame, key: str, size: int, offset: int, length: int) -> DataFrame:
    """key and part, touching only the chunks that the range meets."""
    first, last = offset // size, (offset + max(length, 1) - 1) // size
    need = meta.where(F.col("size") > offset).select(key, F.posexplode(F.slice("chunk_hashes", first + 1, last - first + 1)).alias("chunk_no", "hash"))
    got = need.join(store, "hash").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"))
    return got.select(key, F.substring(_joined(F.transform("c", lambda x: x["chunk"])), offset - first * size + 1, length).alias("part"))


def live(meta: DataFrame, as_of: Column, deleted: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Blobs that are neither deleted nor expired."""
    out = meta.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)) if "expires_at" in meta.columns else meta
    return out if deleted is None else out.join(deleted.select(key), key, "left_anti")


def garbage(store: DataFrame, live_meta: DataFrame, as_of: Column, grace: str = "1 hour") -> DataFrame:
    """Chunks that no live blob holds and that have lain there (since stored_at) for the grace time."""
    unheld = store.join(live_meta.select(F.explode("chunk_hashes").alias("hash")).distinct(), "hash", "left_anti")
    return unheld.where(F.col("stored_at") <= as_of - F.expr(f"INTERVAL {grace}")) if "stored_at" in store.columns else unheld


def dedup_stats(chunked: DataFrame) -> DataFrame:
    """total and unique chunks and bytes, and the bytes saved, of chunks (hash, chunk)."""
    per = chunked.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.length("chunk")).alias("b"))
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.count(F.lit(1)).alias("unique_chunks"),
        F.coalesce(F.sum(F.col("n") * F.col("b")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("unique_bytes"),
    )
    return out.withColumn("saved", F.col("bytes") - F.col("unique_bytes"))


def usage(blobs: DataFrame) -> DataFrame:
    """blobs and bytes of each namespace."""
    return blobs.groupBy("namespace").agg(F.count(F.lit(1)).alias("blobs"), F.sum("size").cast("bigint").alias("bytes"))


def over_quota(used: DataFrame, quotas: DataFrame, more: int = 0) -> DataFrame:
    """Namespaces whose use, with so many bytes more, passes max_bytes or max_blobs."""
    extra_blob = 1 if more else 0
    passed = (F.col("bytes") + more > F.col("max_bytes")) | (F.col("blobs") + extra_blob > F.col("max_blobs"))
    return used.join(quotas, "namespace").where(passed)


def valid_namespace(c: Column) -> Column:
    """Letters, digits, dots, dashes and underscores, at most 255 bytes, no two dots together."""
    return F.coalesce(c.rlike(NAMESPACE) & (F.octet_length(c) <= 255) & ~c.contains(".."), F.lit(False))


def multipart(parts: DataFrame, key: str) -> DataFrame:
    """key and data of uploads (key, part_no, data) put together in order; the last upload of a part counts."""
    last = parts.groupBy(key, "part_no").agg(F.max_by("data", "uploaded_at").alias("data"))
    whole = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part_no", "data"))).alias("p"))
    return whole.select(key, _joined(F.transform("p", lambda x: x["data"].cast("binary"))).alias("data"))


def listing(meta: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return meta.orderBy(key).offset(offset).limit(limit)
