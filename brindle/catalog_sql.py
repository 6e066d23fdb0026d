"""Queries of the catalogue that are SQL text: the engine's semantics, Spark's SQL, and statements on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.catalog import query
from brindle.plans import sqlfront
from brindle.plans.tables import ConstraintError, TableStore
from brindle.session import load_tables, scratch_dir


def _run(spark: SparkSession, d: str, script: str, names: str, args=None, store: TableStore | None = None) -> DataFrame:
    load_tables(spark, d, names.split())
    return sqlfront.run(spark, script, args, store)


@query("SELECT p_partkey, CAST(p_size // 7 AS DOUBLE) AS q, p_retailprice / 7 AS h, CAST((p_size * 3) // 2 AS DOUBLE) + 1 AS e FROM part")
def sql_division(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "SELECT p_partkey, p_size / 7 AS q, p_retailprice / 7 AS h, p_size * 3 / 2 + 1 AS e FROM part", "part")


@query("SELECT p_type, CAST(sum(p_size) AS DOUBLE) AS s, CAST(sum(p_size) AS DOUBLE) / count(*) AS a FROM part GROUP BY 1 HAVING sum(p_size) > 100")
def sql_sum_is_double(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "SELECT p_type, SUM(p_size) AS s, SUM(p_size) / count(*) AS a FROM part GROUP BY p_type HAVING SUM(p_size) > 100", "part")


_LABELLED = "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY "


@query(_LABELLED + "l.quality ASC NULLS LAST, d.doc_id LIMIT 60")
def sql_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _LABELLED + "l.quality, d.doc_id LIMIT 60", "documents labels")


@query(_LABELLED + "l.quality DESC NULLS FIRST, d.doc_id DESC LIMIT 60")
def sql_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _LABELLED + "l.quality DESC, d.doc_id DESC LIMIT 60", "documents labels")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type <> 'it''s; --'")
def sql_parameters(spark: SparkSession, d: str) -> DataFrame:
    script = "SELECT 1; /* one; */ SELECT p_partkey FROM part WHERE p_size BETWEEN :lo AND :hi AND p_type <> :t -- end"
    return _run(spark, d, script, "part", {"lo": 10, "hi": 20, "t": "it's; --"})


@query(
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"
    " AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)"
)
def sql_subqueries(spark: SparkSession, d: str) -> DataFrame:
    return _run(
        spark,
        d,
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"
        " AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
        "customer orders nation",
    )


_SETS = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 1000 {} SELECT s_nationkey AS k FROM supplier"


@query(_SETS.format("UNION"))
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _SETS.format("UNION"), "customer supplier")


@query(_SETS.format("UNION ALL"))
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _SETS.format("UNION ALL"), "customer supplier")


@query(_SETS.format("INTERSECT"))
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _SETS.format("INTERSECT"), "customer supplier")


@query(_SETS.format("EXCEPT"))
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _SETS.format("EXCEPT"), "customer supplier")


_WINDOWS = (
    "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn,"
    " CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,"
    " round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders"
)


@query(_WINDOWS)
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _WINDOWS, "orders")


_GROUPS = "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY {}"


@query(_GROUPS.format("ROLLUP (l_returnflag, l_linestatus)"))
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _GROUPS.format("ROLLUP (l_returnflag, l_linestatus)"), "lineitem")


@query(_GROUPS.format("CUBE (l_returnflag, l_linestatus)"))
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, _GROUPS.format("CUBE (l_returnflag, l_linestatus)"), "lineitem")


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0", "supplier nation")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_hint(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "SELECT /*+ MERGE(customer) */ o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders customer")


# ---- statements on stored tables

_CREATE = "CREATE TABLE placed (id INT PRIMARY KEY, status VARCHAR(10) NOT NULL, price FLOAT DEFAULT 1.5, note TEXT, CHECK (price > 0));"
_FILL = "INSERT INTO placed (id, status, price) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders;"


def _placed(spark: SparkSession, d: str, script: str, args=None) -> DataFrame:
    return _run(spark, d, _CREATE + _FILL + script, "orders", args, TableStore(spark, scratch_dir(spark)))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, CAST(NULL AS VARCHAR) AS note FROM orders UNION ALL SELECT -1, 'N', 1.5, 'it''s' UNION ALL SELECT -2, 'N', 3.0, NULL")
def sql_insert(spark: SparkSession, d: str) -> DataFrame:
    more = "INSERT INTO placed (id, status, note) VALUES (-1, 'N', 'it''s'); INSERT INTO placed VALUES (-2, 'N', 7 / 2, NULL); SELECT * FROM placed"
    return _placed(spark, d, more)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'P' THEN 'was ' || CAST(o_orderkey AS VARCHAR) END AS note FROM orders")
def sql_update(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d, "UPDATE placed SET price = price * 2, note = concat('was ', id) WHERE status = :s; SELECT id, price, note FROM placed", {"s": "P"})


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_totalprice < 50000 OR o_orderstatus = 'F')")
def sql_delete(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d, "DELETE FROM placed WHERE price < 50000 OR status = 'F'; SELECT id FROM placed")


@query("SELECT CAST(count(*) AS BIGINT) AS rows_affected FROM orders WHERE o_orderstatus = 'O'")
def sql_rows_affected(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d, "DELETE FROM placed WHERE status = 'O'")


@query("SELECT i AS statement, i IN (0, 4) AS accepted, (SELECT count(*) FROM orders) + CASE WHEN i = 0 THEN 1 WHEN i < 4 THEN 1 ELSE 2 END AS rows_after FROM range(6) t(i)")
def sql_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Each statement is taken whole or refused whole: a key that is there, a missing value, a check, and rows that are fine but for one."""
    load_tables(spark, d, ["orders"])
    store, out = TableStore(spark, scratch_dir(spark)), []
    sqlfront.run(spark, _CREATE + _FILL, store=store)
    values = ("(-1, 'a', 1, 'x')", "(-1, 'b', 2, 'x')", "(-2, NULL, 1, 'x')", "(-3, 'c', 0, 'x')", "(-4, 'd', 1, 'x')", "(-5, 'e', 1, 'x'), (-6, 'f', -1, 'x')")
    for i, row in enumerate(values):
        try:
            sqlfront.run(spark, f"INSERT INTO placed VALUES {row}", store=store)
            ok = True
        except ConstraintError:
            ok = False
        out.append((i, ok, store.count("placed")))
    return spark.createDataFrame(out, "statement long, accepted boolean, rows_after long")
