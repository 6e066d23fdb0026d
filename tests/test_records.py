"""Events, documents, queues, caches, jobs, blobs and key-value tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.operators import blobs, queues, relational
from brindle.operators.documents import EvolutionError, Field, Rule, Schema, not_unique, violations, widens
from brindle.sources import io
from brindle.streaming import events as E


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


# ---- events


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("a.b", "a.b", "a.b.c"), ("a.+", "a.x", "a.x.y"), ("a.*", "a", "b"), ("a.*", "a.b.c", "ab.c"), ("*", "x.y", None), ("+.b", "x.b", "b"), ("a.+.*", "a.b", "a")],
)
def test_topics(spark, pattern, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "t string").where(E.topic_matches(F.col("t"), pattern))
    assert [r.t for r in df.collect()] == [yes]


def test_bad_patterns():
    for p in ("", "a..b", "*.a"):
        with pytest.raises(E.PatternError):
            E.topic_regex(p)


PAYLOADS = ['{"a": 5, "s": "abc", "o": {"x": true}}', '{"a": "5", "n": null}', "not json", None, "[1]"]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (E.Equals(["a"], 5), [0]),
        (E.Equals(["a"], "5"), [1]),
        (E.Equals(["o", "x"], True), [0]),
        (E.Exists(["n"]), [1]),
        (E.Exists(["z"]), []),
        (E.Matches(["s"], "^ab"), [0]),
        (E.In(["a"], [1, "5"]), [1]),
        (E.Range(["a"], 5, 9), [0]),
        (E.Range(["s"], "abb", "abd"), [0]),
        (E.Not(E.Exists(["s"])), [1, 4]),
        (E.And([E.Exists(["a"]), E.Exists(["s"])]), [0]),
        (E.Or([E.Exists(["n"]), E.Exists(["s"])]), [0, 1]),
    ],
)
def test_filters(spark, f, want):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "id int, payload string")
    assert ids(df.where(f.column())) == want


def test_routing_log_and_dead_letters(spark):
    df = spark.createDataFrame([(i, f"a.{'bc'[i % 2]}", f"2024-01-{i + 1:02d}", "{}") for i in range(9)] + [(9, "flat", "2024-01-10", "{}")], "event_id long, event_type string, d string, payload string")
    df = df.withColumn("ts", F.to_timestamp("d"))
    subs = spark.createDataFrame([("s1", "a.*"), ("s2", "a.b")], "subscriber string, pattern string")
    assert E.routed(df, subs).groupBy("subscriber").count().orderBy("subscriber").collect()[1]["count"] == 5
    good, bad = E.published(df)
    assert good.count() == 9 and bad.head().reason == "bad event type"
    log = E.with_offsets(good, "ts", "event_id")
    assert [r.offset for r in log.orderBy("event_id").collect()] == list(range(9))
    assert ids(E.replay(log, after=2, until="2024-01-07", pattern="a.b"), "event_id") == [4, 6]
    assert ids(E.replay(log, after=-1), "event_id")[0] == 0
    assert ids(E.retained(log, 3), "event_id") == [6, 7, 8]
    assert ids(E.newest_dead(df, 2), "event_id") == [8, 9]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_type", F.concat(F.lit("x."), "event_type"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    keep = lambda d: d.where(E.topic_matches(F.col("event_type"), "x.+") & E.Range(["k"], 10, 50).column("props"))
    q = keep(E.stream(spark, f"{tmp_path}/in", df.schema, 1)).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ids(spark.table("kept"), "event_id") == ids(keep(df), "event_id")
    q = E.windowed_counts(E.stream(spark, f"{tmp_path}/in", df.schema), "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).head()[0] == df.count()


def test_token_bucket(spark):
    df = spark.createDataFrame([(i, "u", i // 3) for i in range(9)], "event_id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = E.allowed_by_bucket(df, "user", rate=1, burst=2).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, False, True, False, False, True, False, False]


# ---- documents


def test_rules(spark):
    df = spark.createDataFrame([("en", 5, 3, [1]), ("EN", 50, 60, None), (None, None, 1, [1, 2])], "lang string, n int, m int, xs array<int>")
    rules = [Rule.pattern("lang", "^[a-z]{2}$"), Rule.between("n", 1, 10), Rule.compare("m", "<", "n"), Rule.items("xs", 0, 1), Rule.bytes_at_most("lang", 2)]
    got = [r[0] for r in df.select(violations(rules)).collect()]
    assert got == [[], ["lang: pattern", "n: range", "m < n"], ["xs: items"]]
    assert not_unique(spark.createDataFrame([(1,), (1,), (None,), (None,)], "x int"), "x").collect()[0].n == 2


def test_schema(spark):
    s = Schema((Field("id", "int64", required=True), Field("small", "uint8"), Field("name", "string", max_length=3), Field("kind", "string", values=("a", "b"), default="a")))
    docs = ['{"id": 1, "small": 255}', '{"small": 256}', '{"id": "x", "name": "long", "kind": "c"}', '{"id": 1, "zz": 2}', "no", None]
    df = spark.createDataFrame([(d,) for d in docs], "data string")
    got = [r[0] for r in df.select(s.violations("data")).collect()]
    assert got[0] == []
    assert got[1] == ["id: missing", "small: not uint8"]
    assert got[2] == ["id: not int64", "name: too long", "kind: not one of its values"]
    assert got[3] == ["unknown fields"] and got[4] == ["not an object"] and got[5] == ["not an object"]
    assert [f.name for f in Schema(s.fields, "mixed", 2).struct()][-1] == "extra"


def test_evolution(spark):
    s = Schema((Field("a", "int32", required=True), Field("t", "string", max_length=5)))
    t = s.widen("a", "int64").make_optional("a").add_field(Field("b", "string", default="x")).longer("t", 9).deprecate("t").add_index("a")
    assert t.version == 7 and t.struct()["a"].nullable
    assert widens("int8", "int64") and not widens("int64", "int8") and not widens("int32", "float64")
    for bad in (lambda: s.widen("a", "int8"), lambda: s.add_field(Field("a", "any")), lambda: s.longer("t", 2), lambda: s.add_field(Field("c", "bool", required=True)), lambda: s.get("q")):
        with pytest.raises(EvolutionError):
            bad()
    old = spark.createDataFrame([(1, "q")], "a int, t string")
    assert [tuple(r) for r in t.read_as(old).collect()] == [(1, "q", "x")]


# ---- queues, caches, jobs


def test_queue_states(spark):
    m = spark.sql(
        """SELECT id, 'q' AS queue, timestamp(v) AS visible_at, timestamp(e) AS expires_at, a AS attempt_count, 3 AS max_receives, p AS priority, timestamp('2024-01-01') AS enqueued_at
        FROM VALUES (1, '2024-01-01', NULL, 0, 0), (2, '2024-02-01', NULL, 0, 0), (3, '2024-02-01', NULL, 1, 0), (4, '2024-01-01', NULL, 3, 0),
        (5, '2024-01-01', '2024-01-02', 0, 0), (6, '2024-01-01', NULL, 0, 2) AS t(id, v, e, a, p)"""
    )
    now = "2024-01-10"
    assert {r.id: r.state for r in queues.with_state(m, now).collect()} == {1: "available", 2: "delayed", 3: "in_flight", 4: "dead", 5: "expired", 6: "available"}
    assert queues.state_counts(m, now).head().total == 6
    assert [r.id for r in queues.dequeue(m, now, 5).collect()] == [6, 1]
    got = queues.after_receive(m, spark.createDataFrame([(6,)], "id int"), now, 30)
    assert [r.id for r in queues.dequeue(got, now, 5).collect()] == [1] and got.where("id = 6").head().attempt_count == 1
    back = queues.returned(got, spark.createDataFrame([(6,)], "id int"), now)
    assert [r.id for r in queues.dequeue(back, now, 5).collect()] == [6, 1]
    assert ids(queues.acknowledged(m, spark.createDataFrame([(1,)], "id int"))) == [2, 3, 4, 5, 6]
    live, dead = queues.swept(m, now)
    assert ids(live) == [1, 2, 3, 6] and ids(dead) == [4]
    new = queues.enqueued(spark.createDataFrame([(1, "d"), (2, "d"), (3, None), (4, None)], "id int, dedup_id string"), now, 60)
    assert ids(new) == [1, 3, 4] and queues.with_state(new, now).head().state == "delayed"


def test_caches(spark):
    e = spark.sql("SELECT key, timestamp('2024-01-01') AS written_at, t AS ttl_ms, timestamp(r) AS read_at, 10 AS bytes FROM VALUES ('a:1', 1000, '2024-01-03'), ('a:2', NULL, '2024-01-02'), ('b', 10000000000, '2024-01-01') AS x(key, t, r)")
    assert ids(queues.live_entries(e, "2024-01-02"), "key") == ["a:2", "b"]
    assert ids(queues.invalidated(e, ["a:*"]), "key") == ["b"]
    assert ids(queues.kept_by_bytes(e, 20), "key") == ["a:1", "a:2"]


def test_jobs(spark):
    j = spark.sql("SELECT id, state, timestamp(t) AS next_run_at, d AS depends_on, cron, i AS interval_ms FROM VALUES (1, 'pending', '2024-01-01', array(2), '0 3 * * *', NULL), (2, 'completed', '2024-01-01', array(), NULL, 5000), (3, 'pending', '2025-01-01', array(9), NULL, NULL) AS x(id, state, t, d, cron, i)")
    assert ids(queues.due_jobs(j, "2024-06-01", 5)) == [1]
    assert ids(queues.unblocked(j)) == [1, 2]
    next_run = {r.id: str(r.next_run_at) for r in queues.rescheduled(j, "2024-01-01").select("id", F.col("next_run_at").cast("string").alias("next_run_at")).collect()}
    assert next_run == {1: "2024-01-01 03:00:00", 2: "2024-01-01 00:00:05", 3: "None"}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (6, 1)], "id int, depends_on int")
    assert ids(queues.cyclic(edges)) == [1, 2, 3, 6]


# ---- blobs


def test_blobs(spark):
    texts = {1: "abcdefghij", 2: "abcdefgh", 3: "", 4: "abcdxxxxabcd"}
    df = spark.createDataFrame(list(texts.items()), "id int, data string")
    meta, store = blobs.put(df, "id", "data", 4)
    got = {r.id: r for r in blobs.download(meta, store, "id").collect()}
    assert {i: r.data.decode() for i, r in got.items()} == texts and all(r.verified for r in got.values())
    broken = store.withColumn("chunk", F.when(F.col("chunk") == b"efgh", F.lit(b"EFGH")).otherwise(F.col("chunk")))
    assert {r.id for r in blobs.download(meta, broken, "id").where("NOT verified").collect()} == {1, 2}
    refs = {r.hash: r.refs for r in blobs.reference_counts(meta).collect()}
    assert refs[hashlib.sha256(b"abcd").hexdigest()] == 4
    assert {r.id: bytes(r.part) for r in blobs.read_chunk_range(meta, store, "id", 4, 3, 4).collect()} == {1: b"defg", 2: b"defg", 4: b"dxxx"}
    assert {r.id: bytes(r.part) for r in blobs.read_range(df, "data", 8, 10).collect()} == {1: b"ij", 4: b"abcd"}
    left = blobs.live(meta, F.lit(None).cast("timestamp"), spark.createDataFrame([(4,)], "id int"))
    assert [bytes(r.chunk) for r in blobs.garbage(store, left, F.current_timestamp()).collect()] == [b"xxxx"]
    s = blobs.dedup_stats(blobs.chunks(df, "data", 4)).head()
    assert (s.chunks, s.unique_chunks, s.saved) == (9, 5, 16)
    used = blobs.usage(spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "namespace string, size int"))
    quotas = spark.createDataFrame([("a", 10, 5), ("b", 10, 5)], "namespace string, max_bytes long, max_blobs long")
    assert ids(blobs.over_quota(used, quotas), "namespace") == ["a"]
    names = spark.createDataFrame([("ok-1.x",), ("a/b",), ("a..b",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(blobs.valid_namespace(F.col("n"))).collect()] == [True, False, False, False, False]
    parts = spark.createDataFrame([(1, 2, "b", 1), (1, 1, "x", 1), (1, 1, "a", 2)], "id int, part_no int, data string, uploaded_at int")
    assert bytes(blobs.multipart(parts, "id").head().data) == b"ab"


def test_blobs_are_bytes(spark):
    """Not UTF-8, characters of several bytes across a chunk's end, and nothing at all."""
    raw = {1: bytes(range(256)) * 3, 2: "äöü→日本".encode(), 3: b"", 4: b"\xff\xfe\x00"}
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in raw.items()], "id int, data binary")
    meta, store = blobs.put(df, "id", "data", 5)
    got = {r.id: (bytes(r.data), r.verified) for r in blobs.download(meta, store, "id").collect()}
    assert got == {i: (x, True) for i, x in raw.items()}
    assert {r.id: r.size for r in meta.collect()} == {i: len(x) for i, x in raw.items()}
    for at, n in ((0, 3), (4, 2), (7, 300), (255, 1)):
        parts = {r.id: bytes(r.part) for r in blobs.read_chunk_range(meta, store, "id", 5, at, n).collect()}
        assert parts == {i: x[at : at + n] for i, x in raw.items() if len(x) > at}
    text = spark.createDataFrame([(1, "äöü")], "id int, data string")
    assert [bytes(r.chunk) for r in blobs.chunks(text, "data", 3).orderBy("chunk_no").collect()] == ["äöü".encode()[:3], "äöü".encode()[3:]]


# ---- tables of keys


def test_keys(spark, tmp_path):
    a = spark.createDataFrame([(1, "old"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "new")], "k int, v string")
    assert {r.k: r.v for r in relational.compacted([a, b], ["k"]).collect()} == {1: "new", 2: "b"}
    log = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, 1, True), (4, 3, False)], "lsn int, k int, del boolean")
    assert ids(relational.replayed(log, ["k"], "lsn", "del"), "k") == [2, 3]
    assert ids(relational.replayed(log, ["k"], "lsn", "del", after=1, up_to=2), "k") == [2]
    io.write_sorted(spark.range(100), f"{tmp_path}/kv", ["id"], 4)
    assert relational.key_range(io.parquet(spark, f"{tmp_path}/kv"), "id", 10, 20).count() == 10
    h = relational.histogram(spark.createDataFrame([(0.5,), (3.0,), (99.0,)], "v double"), "v", [1, 10]).collect()
    assert [(r.upper, r.n) for r in h] == [(1.0, 1), (10.0, 1), (None, 1)]
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 5)], "k string, t int")
    right = spark.createDataFrame([("x", 2, 20), ("x", 5, 50)], "k string, t int, p int")
    assert {(r.k, r.t): r.p for r in relational.as_of_join(left, right, ["k"], "t", "p").collect()} == {("x", 5): 50, ("x", 1): None, ("y", 5): None}
    assert io.envelope(spark.range(3), 2)["row_count"] == 2
    assert io.as_json_rows(spark.createDataFrame([(1, None)], "a int, b int")).head().row == '{"a":1,"b":null}'
