import pytest
from pyspark.sql import functions as F

from brindle.plans import sqlfront
from brindle.plans.tables import Col, ConstraintError, StaleTable, TableError, TableStore


def test_split_and_depth():
    assert sqlfront.statements("SELECT ';' -- x;\n; /* ; */ SELECT 2;") == ["SELECT ';'", "SELECT 2"]
    assert sqlfront.depth("SELECT ((1))") == 2
    with pytest.raises(sqlfront.QueryTooComplex):
        sqlfront.guarded("SELECT " + "(" * 70 + "1" + ")" * 70)
    assert sqlfront.guarded("SELECT " + "(" * 60 + "1" + ")" * 60)


def test_script_and_parameters(spark):
    spark.range(5).createOrReplaceTempView("t5")
    assert sqlfront.run(spark, "SELECT 1; SELECT id FROM t5 WHERE id > :low", {"low": 2}).count() == 2
    assert "Physical Plan" in sqlfront.explain(spark, "SELECT id FROM t5")
    assert sqlfront.run(spark, "SELECT a.id FROM t5 a JOIN t5 b ON a.id = b.id + 1 GROUP BY a.id HAVING count(*) = 1").count() == 4


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}")


COLS = [Col("id", "INTEGER", primary_key=True), Col("name", "TEXT", nullable=False), Col("n", "int", default="42"), Col("at", "string", default="CAST(current_timestamp() AS STRING)"), Col("k", "text", unique=True, check="length(k) < 5")]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_insert_defaults_and_constraints(spark, store):
    store.create("t", COLS)
    assert store.tables() == ["t"] and store.count("t") == 0
    with pytest.raises(TableError):
        store.create("t", COLS)
    store.insert("t", rows(spark, [(1, "a", None), (2, "b", None), (3, "c", "x")], "id long, name string, k string"))
    got = {r.id: r for r in store.read("t").collect()}
    assert got[1].n == 42 and got[1]["at"] and got[3].k == "x"
    for bad in ([(1, "z", None)], [(4, None, None)], [(5, "e", "x")], [(6, "f", "too long")], [(None, "g", None)]):
        with pytest.raises(ConstraintError):
            store.insert("t", rows(spark, [(7, "ok", None), *bad], "id long, name string, k string"))
    assert store.count("t") == 3  # all or nothing
    assert [c["kind"] for c in store.changes("t")] == ["created", "insert"]


def test_update_delete_drop(spark, store):
    store.create("u", [Col("a", "int"), Col("b", "int"), Col("s", "text")])
    store.insert("u", rows(spark, [(1, 10, "x"), (2, 20, None), (None, 30, "z")], "a long, b long, s string"))
    assert store.update("u", {"a": F.col("b"), "b": F.col("a")}, F.col("a") >= 1) == 2
    assert sorted((r.a or 0, r.b) for r in store.read("u").collect()) == [(0, 30), (10, 1), (20, 2)]
    assert store.delete("u", F.col("a") > 5) == 2
    assert store.count("u") == 1
    assert spark.sql("SELECT count(*) FROM u").head()[0] == 1
    store.drop("u")
    with pytest.raises(TableError):
        store.read("u")


def test_auto_increment(spark, store):
    store.create("v", [Col("id", "int", auto_increment=True), Col("x", "text")])
    for _ in range(2):
        store.insert("v", rows(spark, [("a",), ("b",)], "x string"))
    assert sorted(r.id for r in store.read("v").collect()) == [1, 2, 3, 4]


def test_a_statement_that_was_overtaken_is_refused(spark, store):
    """Two writers that plan from one version: the first wins, the other is told so and leaves nothing."""
    store.create("w", [Col("a", "int")])
    store.insert("w", rows(spark, [(1,)], "a long"))
    other = TableStore(spark, store.path)
    meta = store._meta("w")
    other.insert("w", rows(spark, [(2,)], "a long"))
    with pytest.raises(StaleTable):
        store._commit("w", meta, rows(spark, [(3,)], "a long"), "insert", 1, onto=True)
    assert sorted(r.a for r in store.read("w").collect()) == [1, 2]
    assert [c["kind"] for c in store.changes("w")] == ["created", "insert", "insert"]
    store.delete("w", F.col("a") == 1)
    assert store.vacuum("w") == 2 and [r.a for r in store.read("w").collect()] == [2]


def test_insert_adds_files(spark, store):
    store.create("x", [Col("a", "int", unique=True)])
    store.insert("x", rows(spark, [(1,), (None,)], "a long"))
    before = store._meta("x")["data"]
    store.insert("x", rows(spark, [(2,), (None,)], "a long"))
    assert store._meta("x")["data"][:1] == before and store.count("x") == 4
    with pytest.raises(ConstraintError):
        store.insert("x", rows(spark, [(2,)], "a long"))
    with pytest.raises(TableError):
        store.update("x", {"nothing": F.lit(1)})


def test_statements_in_text(spark, store):
    go = lambda s, args=None: sqlfront.run(spark, s, args, store)
    go("CREATE TABLE people (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(20) NOT NULL, age INT DEFAULT 42, mail TEXT UNIQUE CHECK (mail LIKE '%@%'))")
    assert go("INSERT INTO people (name, mail) VALUES ('Ann; -- x', 'a@b'), ('O''Neil', NULL)").head().rows_affected == 2
    assert sorted(tuple(r) for r in go("SELECT * FROM people").collect()) == [(1, "Ann; -- x", 42, "a@b"), (2, "O'Neil", 42, None)]
    for bad in ("(NULL, 'c@d')", "('x', 'a@b')", "('x', 'no mail')"):
        with pytest.raises(ConstraintError):
            go(f"INSERT INTO people (name, mail) VALUES {bad}")
    for bad in ("INSERT INTO people (nobody) VALUES (1)", "INSERT INTO people (name) VALUES (1, 2)", "UPDATE people SET nobody = 1", "CREATE TABLE people (a INT)", "CREATE TABLE q (a SHAPE)", "DROP TABLE nothing"):
        with pytest.raises(TableError):
            go(bad)
    assert go("UPDATE people SET age = age / 4, name = concat(name, '!') WHERE name LIKE :n", {"n": "O'%"}).head().rows_affected == 1
    assert go("SELECT age, name FROM people WHERE id = ?", [2]).head() == (10, "O'Neil!")
    assert go("DELETE FROM people WHERE mail IS NULL; SELECT count(*) AS n FROM people").head().n == 1
    assert [r[0] for r in go("SHOW TABLES").collect()] == ["people"]
    go("DROP TABLE people")
    assert store.tables() == []


def test_text_has_the_engines_semantics(spark):
    one = lambda s: sqlfront.run(spark, s).head()[0]
    assert one("SELECT 7 / 2") == 3 and one("SELECT -7 / 2") == -3 and one("SELECT 7 / 2.0") == 3.5
    assert one("SELECT 2 * 7 / 4 / 2 + 1") == 2 and one("SELECT (1 + 6) / (SELECT 2)") == 3 and one("SELECT '7/2'") == "7/2"
    assert one("SELECT CASE WHEN 7 / 2 = 3 THEN 9 ELSE 1 END / 2") == 4
    t = "(SELECT * FROM VALUES (2), (NULL), (1) AS t(a))"
    order = lambda o: [r.a for r in sqlfront.run(spark, f"SELECT a FROM {t} ORDER BY a {o}").collect()]
    assert order("") == [1, 2, None] and order("DESC") == [None, 2, 1] and order("NULLS FIRST") == [None, 1, 2]
    assert sqlfront.run(spark, f"SELECT SUM(a) AS s FROM {t}").dtypes == [("s", "double")]
    assert one(f"SELECT first_value(a) OVER (ORDER BY a) FROM {t}") == 1
    assert "BROADCAST" in sqlfront.engine_sql("SELECT /*+ BROADCAST(t) */ a FROM t -- c")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one("SELECT 1 / 0")
