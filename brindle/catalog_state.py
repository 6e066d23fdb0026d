"""Queries of the catalogue for blobs, queues, routing, documents, schedules and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.catalog import query
from brindle.functions.cron import next_fire
from brindle.functions.merkle import merkle_root
from brindle.functions.scalar import cast_to
from brindle.operators import blobs, queues, relational
from brindle.operators.documents import Field, Rule, Schema, violations
from brindle.session import table
from brindle.streaming import events as bus

# ---- blobs: of bytes

_CHUNKS = (
    "SELECT doc_id, i AS chunk_no, sha256(encode(coalesce(text, ''))[i*64+1:i*64+64]) AS h, octet_length(encode(coalesce(text, ''))[i*64+1:i*64+64]) AS b FROM"
    " (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(strlen(coalesce(text, ''))/64.0) AS BIGINT)))) AS i FROM documents)"
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, chunk_no, h FROM ({_CHUNKS})")
def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    return blobs.chunks(_texts(spark, d), "text", 64).select("doc_id", "chunk_no", F.col("hash").alias("h"))


@query(f"SELECT h, CAST(count(*) AS BIGINT) AS refs FROM ({_CHUNKS}) GROUP BY 1")
def dedup_refcount(spark: SparkSession, d: str) -> DataFrame:
    meta, _ = blobs.put(_texts(spark, d), "doc_id", "text", 64)
    return blobs.reference_counts(meta).withColumnRenamed("hash", "h")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS chunks, CAST(count(*) AS BIGINT) AS unique_chunks, CAST(sum(n * b) AS BIGINT) AS bytes, CAST(sum(b) AS BIGINT) AS unique_bytes, CAST(sum(n * b) - sum(b) AS BIGINT) AS saved FROM (SELECT h, count(*) AS n, any_value(b) AS b FROM ({_CHUNKS}) GROUP BY 1)")
def blob_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return blobs.dedup_stats(blobs.chunks(_texts(spark, d), "text", 64)).select(*(F.col(c).cast("bigint") for c in ("chunks", "unique_chunks", "bytes", "unique_bytes", "saved")))


@query("SELECT h, CAST(count(*) AS BIGINT) AS refs, CAST(any_value(b) AS BIGINT) AS size FROM (SELECT sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS b FROM documents) GROUP BY 1 HAVING count(*) > 1")
def blob_duplicates(spark: SparkSession, d: str) -> DataFrame:
    meta, _ = blobs.put(_texts(spark, d), "doc_id", "text", 1024)
    return meta.groupBy(F.col("content_hash").alias("h")).agg(F.count(F.lit(1)).alias("refs"), F.any_value("size").cast("bigint").alias("size")).where("refs > 1")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS size, true AS verified FROM documents")
def blob_download(spark: SparkSession, d: str) -> DataFrame:
    meta, store = blobs.put(_texts(spark, d), "doc_id", "text", 256)
    return blobs.download(meta, store, "doc_id").select("doc_id", F.sha2("data", 256).alias("h"), F.length("data").cast("bigint").alias("size"), "verified")


@query("SELECT doc_id, hex(encode(text)[101:250]) AS part FROM documents WHERE strlen(text) > 100")
def range_read(spark: SparkSession, d: str) -> DataFrame:
    """Bytes 100 to 250, from the chunks that the range meets."""
    meta, store = blobs.put(_texts(spark, d), "doc_id", "text", 64)
    return blobs.read_chunk_range(meta, store, "doc_id", 64, 100, 150).select("doc_id", F.hex("part").alias("part"))


@query(
    "SELECT n_regionkey, sha256(sha256(sha256(k[1]) || sha256(k[2])) || sha256(sha256(k[3]) || sha256(k[4]))) AS root FROM"
    " (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS k FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i <= 4 GROUP BY 1)"
)
def merkle_roots(spark: SparkSession, d: str) -> DataFrame:
    first = relational.latest(table(spark, d, "nation").withColumn("one", F.lit(1)), ["n_nationkey"], ["one"])
    names = first.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("k"))
    return names.select("n_regionkey", merkle_root(F.transform(F.slice("k", 1, 4), lambda x: F.sha2(x["n_name"], 256))).alias("root"))


# ---- queues and schedules


def _messages(spark: SparkSession, d: str) -> DataFrame:
    tries = F.pmod("event_id", F.lit(4)).cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("queue"), F.col("ts").alias("visible_at"), (F.col("ts") + F.expr("INTERVAL 6 DAYS")).alias("expires_at"), tries.alias("attempt_count"), F.lit(3).alias("max_receives")
    )


_STATES = (
    "SELECT event_id, event_type, CASE WHEN ts + INTERVAL 6 DAY <= TIMESTAMP '2024-01-15' THEN 'expired' WHEN ts <= TIMESTAMP '2024-01-15' AND event_id % 4 >= 3 THEN 'dead'"
    " WHEN ts <= TIMESTAMP '2024-01-15' THEN 'available' WHEN event_id % 4 > 0 THEN 'in_flight' ELSE 'delayed' END AS st FROM events"
)


@query(
    "SELECT event_type AS queue, " + ", ".join(f"CAST(count(*) FILTER (st = '{s}') AS BIGINT) AS {s}" for s in ("available", "in_flight", "delayed", "dead", "expired"))
    + f", CAST(count(*) AS BIGINT) AS total FROM ({_STATES}) GROUP BY 1"
)
def queue_states_by_queue(spark: SparkSession, d: str) -> DataFrame:
    return queues.state_counts(_messages(spark, d), "2024-01-15")


@query(f"SELECT event_id AS id, st = 'dead' AS dead FROM ({_STATES}) WHERE st <> 'expired'")
def queue_swept(spark: SparkSession, d: str) -> DataFrame:
    live, dead = queues.swept(_messages(spark, d), "2024-01-15")
    return live.select("id", F.lit(False).alias("dead")).union(dead.select("id", F.lit(True).alias("dead")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY ORDER BY o_orderdate, o_orderkey LIMIT 30")
def due_jobs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    as_of = F.lit(orders.agg(F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).head()[0])
    state = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state")
    jobs = orders.select(F.col("o_orderkey").alias("id"), state, F.col("o_orderdate").alias("next_run_at"))
    return queues.due_jobs(jobs, as_of, 30).select(F.col("id").alias("o_orderkey"))


@query("SELECT event_id, date_trunc('day', ts - INTERVAL 3 HOUR) + INTERVAL 27 HOUR AS daily, date_trunc('hour', ts) + INTERVAL (30 * CAST(minute(ts) // 30 + 1 AS INTEGER)) MINUTE AS half FROM events")
def cron_next(spark: SparkSession, d: str) -> DataFrame:
    """The next run of a daily schedule and of one each half an hour; the minute of the event itself is over."""
    at = F.unix_millis(F.date_trunc("minute", "ts"))
    run = lambda text: F.timestamp_millis(next_fire(F.lit(text), at)).cast("timestamp_ntz")
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", run("0 3 * * *").alias("daily"), run("*/30 * * * *").alias("half"))


# ---- events


@query("SELECT event_id, 'all' AS subscriber FROM events UNION ALL SELECT event_id, 'trade' FROM events WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT event_id, 'errors' FROM events WHERE event_type = 'error'")
def event_routing(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_type").isin("purchase", "signup"), "trade.").otherwise("app."), "event_type").alias("event_type"))
    subs = spark.createDataFrame([("all", "*"), ("trade", "trade.+"), ("errors", "app.error"), ("none", "trade")], "subscriber string, pattern string")
    return bus.routed(named, subs).select("event_id", "subscriber")


@query(
    "SELECT event_id FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
    " WHERE (k = 7 OR k IN (20, 30) OR k BETWEEN 40 AND 45) AND NOT k = 44 AND k IS NOT NULL"
)
def json_filters_combined(spark: SparkSession, d: str) -> DataFrame:
    k = ["k"]
    fits = bus.And([bus.Or([bus.Equals(k, 7), bus.In(k, [20, 30]), bus.Range(k, 40, 45)]), bus.Not(bus.Equals(k, 44)), bus.Exists(k), bus.Not(bus.Matches(k, "."))])
    return table(spark, d, "events").where(fits.column("props")).select("event_id")


# ---- documents


@query("SELECT event_id, CAST((CASE WHEN k > 50 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents against a schema and rules over its fields."""
    schema = Schema((Field("k", "int32", required=True), Field("name", "string", values=("click", "view", "purchase", "signup"))))
    data = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("name")))
    rows = table(spark, d, "events").select("event_id", data.alias("data"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    broken = F.size(schema.violations("data")) + F.size(violations([Rule.between("k", high=50)]))
    return rows.select("event_id", broken.cast("bigint").alias("violations"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region, 'open' AS state FROM nation")
def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the first version read as the third: a widened number and a new field with its default."""
    first = Schema((Field("id", "int64"), Field("name", "string"), Field("region", "float32")))
    third = first.widen("region", "float64").add_field(Field("state", "string", required=True, default="open"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("float").alias("region"))
    return third.read_as(rows)


# ---- casts


@query(
    "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS s,"
    " CAST(trunc(p_retailprice) AS BIGINT) AS i, p_size > 0 AS b, CAST(p_size AS DOUBLE) AS f, CAST(p_size AS BIGINT) AS back FROM part"
)
def cast_matrix(spark: SparkSession, d: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size").cast("bigint")
    return table(spark, d, "part").select(
        "p_partkey",
        cast_to(price, "double", "string").alias("s"),
        cast_to(price, "double", "bigint").alias("i"),
        cast_to(size, "bigint", "boolean").alias("b"),
        cast_to(size, "bigint", "double").alias("f"),
        cast_to(cast_to(size, "bigint", "string"), "string", "bigint").alias("back"),
    )
