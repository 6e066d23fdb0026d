"""The named queries of the engine, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scalar import ascending, divide, float_sum, glob_match, ilike, json_get, like
from brindle.operators import blobs, queues, relational, search
from brindle.operators.documents import Rule, violations
from brindle.plans import tables as dml
from brindle.session import table
from brindle.streaming import events as bus

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that DuckDB runs for the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ts: the runs of ASCII letters and digits of all documents, in order."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return docs.select("doc_id", F.regexp_extract_all("text", F.lit("([a-z0-9]+)"), 1).alias("ts"))


DUCK_TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents"


@query(
    "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue"
    " FROM lineitem GROUP BY 1,2"
)
def entry_revenue_by_flag(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    by = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(price), 2).alias("revenue"))


@query("SELECT * FROM region")
def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region")


@query("SELECT p_partkey, p_size + 1 AS size1, p_retailprice * 2 AS price2 FROM part")
def project_expr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") + 1).alias("size1"), (F.col("p_retailprice") * 2).alias("price2"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
def filter_compare(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O','P')")
def pred_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O','P')")
def pred_not_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(~F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_retailprice > 0")
def pred_between_and(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_size").between(5, 15) & (F.col("p_retailprice") > 0)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 15")
def pred_not_between(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(~F.col("p_size").between(5, 15)).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_name LIKE '%1_'")
def pred_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(like(F.col("c_name"), "%1_")).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%a%'")
def pred_ilike(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(ilike(F.col("p_type"), "%a%")).select("p_partkey")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id WHERE l.quality IS NULL")
def pred_null(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").where(F.col("quality").isNull()).select("doc_id")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey=c.c_custkey)")
def pred_exists(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey=o_custkey GROUP BY 1")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    on = F.col("c_custkey") == F.col("s_suppkey") * 3
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "supplier").select("s_suppkey"), on, "full")


@query(
    "SELECT c_custkey FROM customer WHERE NOT EXISTS"
    " (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P' AND o_totalprice > 1000)"
)
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 1000))
    return table(spark, d, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(table(spark, d, "region").select("r_name")))


@query(
    "SELECT n.n_nationkey, m.n_nationkey AS other FROM nation n JOIN nation m"
    " ON n.n_regionkey = m.n_regionkey AND n.n_nationkey < m.n_nationkey"
)
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select("n_nationkey", "n_regionkey"), n.select(F.col("n_nationkey").alias("other"), "n_regionkey")
    return a.join(b, "n_regionkey").where(F.col("n_nationkey") < F.col("other")).select("n_nationkey", "other")


@query(
    "SELECT CAST(count(*) AS BIGINT) AS n, round(CAST(sum(l_quantity) AS DOUBLE),2) AS s, round(avg(l_discount),6) AS a,"
    " min(l_shipdate) AS mn, max(l_shipdate) AS mx FROM lineitem"
)
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(float_sum("l_quantity"), 2).alias("s"),
        F.round(F.avg("l_discount"), 6).alias("a"),
        F.min("l_shipdate").alias("mn"),
        F.max("l_shipdate").alias("mx"),
    )


@query("SELECT CAST(sum(p_size) AS DOUBLE) AS s FROM part")
def agg_sum_int_is_double(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(float_sum("p_size").alias("s"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(r_regionkey) AS DOUBLE) AS s FROM region WHERE r_regionkey < 0")
def agg_empty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").where("r_regionkey < 0").agg(F.count(F.lit(1)).alias("n"), float_sum("r_regionkey").alias("s"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 5")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("n"))


@query("SELECT round(sum(l_tax)/count(*),6) AS r FROM lineitem")
def agg_expr_over_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(F.sum("l_tax") / F.count(F.lit(1)), 6).alias("r"))


@query("SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, CAST(p_size % 7 AS INTEGER) AS r FROM part")
def expr_int_div(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("seven", F.lit(7))
    return part.select("p_partkey", divide(part, "p_size", "seven").alias("q"), (F.col("p_size") % 7).alias("r"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'hi' WHEN o_totalprice > 1000 THEN 'mid' END AS b FROM orders")
def expr_case(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(price > 100000, "hi").when(price > 1000, "mid").alias("b"))


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS t, CAST(o_custkey AS VARCHAR) AS s FROM orders")
def expr_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("t"), F.col("o_custkey").cast("string").alias("s"))


@query("SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS k FROM nation")
def expr_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("-"), F.col("n_regionkey").cast("string")).alias("k"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality ASC NULLS LAST, d.doc_id LIMIT 50 OFFSET 5")
def sort_nulls_last_top(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.orderBy(ascending("quality"), ascending("doc_id")).offset(5).limit(50)


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type").distinct()


@query(
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 5000 OR (o_totalprice = 5000 AND o_orderkey > 0)"
    " ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"
)
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return relational.page_after(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20, (5000.0, 0))


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 5000 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    return dml.updated(table(spark, d, "supplier"), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 5000)


@query("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 5000, false)")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    return dml.deleted(table(spark, d, "supplier"), F.col("s_acctbal") < 5000)


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def constraint_dups(spark: SparkSession, d: str) -> DataFrame:
    return dml.duplicate_keys(table(spark, d, "orders"), ["o_custkey"])


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def facet_lang(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(table(spark, d, "documents"), "lang")


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS tf_total, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM ({DUCK_TERMS}) GROUP BY 1")
def postings_ws(spark: SparkSession, d: str) -> DataFrame:
    per = _tokens(spark, d).select(F.explode(search.term_counts(F.col("ts"))).alias("t"))
    return per.groupBy("t.term").agg(F.sum("t.tf").alias("tf_total"), F.count(F.lit(1)).alias("df"))


@query(
    f"WITH t AS ({DUCK_TERMS}), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), s AS (SELECT (SELECT count(*) FROM documents) AS n,"
    " (SELECT avg(len) FROM l) AS al), p AS (SELECT doc_id, count(*) AS tf FROM t WHERE term='the' GROUP BY 1), d AS (SELECT count(*) AS df FROM p)"
    " SELECT p.doc_id, round(ln((n-df+0.5)/(df+0.5)+1)*(tf*2.2)/(tf+1.2*(0.25+0.75*len/al)),6) AS score FROM p JOIN l USING (doc_id), s, d"
)
def bm25_term(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and frequencies are counted within the rows, so nothing is shuffled but one row of sums a task."""
    per = _tokens(spark, d).select("doc_id", F.size("ts").alias("len"), F.size(F.filter("ts", lambda x: x == "the")).alias("tf"))
    stats = per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avg_len"), F.count_if(F.col("tf") > 0).alias("df"))
    rows = per.where("tf > 0").crossJoin(F.broadcast(stats))
    return rows.select("doc_id", F.round(search.bm25("tf", "len", "avg_len", "n", "df"), 6).alias("score"))


@query(f"SELECT DISTINCT term FROM ({DUCK_TERMS}) WHERE levenshtein(term,'data') <= 2")
def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of other lengths go within the row, before the others are told apart."""
    near = F.filter(F.array_distinct("ts"), lambda x: F.length(x).between(2, 6))
    terms = _tokens(spark, d).select(F.explode(near).alias("term")).distinct()
    return terms.where(F.levenshtein("term", F.lit("data"), 2) >= 0)


@query(f"SELECT DISTINCT term FROM ({DUCK_TERMS}) WHERE starts_with(term,'co')")
def prefix_terms(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select(F.explode(F.filter("ts", lambda x: x.startswith("co"))).alias("term")).distinct()


@query(
    "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text),'[a-z0-9]+'),'this')"
    " AND NOT list_contains(regexp_extract_all(lower(text),'[a-z0-9]+'),'that')"
)
def bool_and_not(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).where(F.array_contains("ts", "this") & ~F.array_contains("ts", "that")).select("doc_id")


@query(
    f"WITH t AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id) AS x FROM ({DUCK_TERMS})),"
    " p AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM"
    " (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents))"
    " SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"
)
def phrase_positions(spark: SparkSession, d: str) -> DataFrame:
    """Within the row: a pair of neighbours that are the two words."""
    ts = F.col("ts")
    pairs = F.arrays_zip(F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0))).alias("a"), F.slice(ts, 2, F.size(ts)).alias("b"))
    return _tokens(spark, d).where(F.exists(pairs, lambda x: (x["a"] == "of") & (x["b"] == "the"))).select("doc_id")


@query(
    "SELECT event_id FROM events WHERE regexp_matches(CASE WHEN event_type IN ('click','view') THEN 'ui.' ELSE 'biz.core.' END || event_type,"
    r" '^biz\.[^.]+\.(error|signup)$')"
)
def topic_match(spark: SparkSession, d: str) -> DataFrame:
    area = F.when(F.col("event_type").isin("click", "view"), "ui.").otherwise("biz.core.")
    named = table(spark, d, "events").select("event_id", F.concat(area, "event_type").alias("topic"))
    either = bus.topic_matches(F.col("topic"), "biz.+.error") | bus.topic_matches(F.col("topic"), "biz.+.signup")
    return named.where(either).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props,'$.k') AS BIGINT) BETWEEN 10 AND 50")
def json_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(bus.Range(["k"], 10, 50).column("props")).select("event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", json_get(F.col("props"), ["k"]).alias("k"))


@query(
    "SELECT event_id, o FROM (SELECT event_id, ts, CAST(row_number() OVER (ORDER BY ts, event_id)-1 AS BIGINT) AS o FROM events)"
    " WHERE o > 99 AND ts <= TIMESTAMP '2024-01-20'"
)
def replay_offsets(spark: SparkSession, d: str) -> DataFrame:
    log = bus.with_offsets(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id")
    return bus.replay(log, after=99, until="2024-01-20").select("event_id", F.col("offset").alias("o"))


@query(
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1"
)
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("deleted"))
    return relational.replayed(log, ["user_id"], "event_id", "deleted")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def kv_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return relational.key_range(table(spark, d, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


@query(
    "WITH b(u) AS (VALUES (1.0),(5.0),(10.0),(50.0),(100.0),(500.0),(1000.0)), c AS (SELECT u, (SELECT count(*) FROM events WHERE value <= u) AS cum"
    " FROM b) SELECT min(CASE WHEN cum >= ceil((SELECT count(*) FROM events)*0.99) THEN CAST(u AS DOUBLE) END) AS p99 FROM c"
)
def histogram_p99(spark: SparkSession, d: str) -> DataFrame:
    return relational.histogram_percentile(table(spark, d, "events"), "value", [1, 5, 10, 50, 100, 500, 1000], 99).withColumnRenamed("percentile", "p99")


AS_OF = "2024-01-15"


@query(
    "SELECT CASE WHEN ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15' THEN 'expired' WHEN ts <= TIMESTAMP '2024-01-15' THEN 'available' ELSE 'delayed' END AS st,"
    " CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1"
)
def queue_state_counts(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "events").select(F.col("ts").alias("visible_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    return queues.with_state(messages, AS_OF).groupBy(F.col("state").alias("st")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15' ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END,"
    " ts, event_id LIMIT 25"
)
def queue_dequeue_rank(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    messages = table(spark, d, "events").select(F.col("event_id").alias("id"), level.alias("priority"), F.col("ts").alias("enqueued_at"), F.col("ts").alias("visible_at"))
    return queues.dequeue(messages, AS_OF, 25).select(F.col("id").alias("event_id"))


@query(
    "SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-15' - INTERVAL 5 DAY THEN least(3, p + 1) ELSE p END AS level FROM"
    " (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END AS p FROM events WHERE ts <= TIMESTAMP '2024-01-15')"
)
def priority_aging(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(0)
    waiting = table(spark, d, "events").where(F.col("ts") <= F.lit(AS_OF).cast("timestamp"))
    return waiting.select("event_id", queues.aged_priority(p, F.col("ts"), AS_OF, "5 days").alias("level"))


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer.*1.$')")
def cache_glob(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(glob_match(F.col("c_name"), "Customer*1?")).select("c_custkey")


@query("SELECT event_type, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (value > 50) / count(*), 6) END AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("h"), F.count(F.lit(1)).alias("n"))
    return hits.select("event_type", F.round(queues.hit_rate(F.col("h"), F.col("n") - F.col("h")), 6).alias("hit_rate"))


@query(
    "SELECT doc_id, CAST(CASE WHEN NOT regexp_matches(lang,'^[a-z]{2}$') THEN 1 ELSE 0 END + CASE WHEN n_chars < 10 THEN 1 ELSE 0 END"
    " + CASE WHEN strlen(text) > 5000 THEN 1 ELSE 0 END AS INTEGER) AS violations FROM documents"
)
def validate_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [Rule.pattern("lang", "^[a-z]{2}$"), Rule.at_least("n_chars", 10), Rule.bytes_at_most("text", 5000)]
    return table(spark, d, "documents").select("doc_id", F.size(violations(rules)).alias("violations"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS blobs, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def quota_usage(spark: SparkSession, d: str) -> DataFrame:
    return blobs.usage(table(spark, d, "documents").select(F.col("source").alias("namespace"), F.col("n_chars").alias("size"))).withColumnRenamed("namespace", "source")


@query("SELECT o_orderstatus AS state, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def job_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


# The other queries; they register themselves.
from brindle import catalog_search, catalog_sql, catalog_state  # noqa: E402, F401
