import hashlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import merkle, scalar, stemmer
from brindle.functions.cron import Cron, CronError, next_fire


@pytest.mark.parametrize(
    ("word", "want"),
    [("running", "run"), ("runner", "runner"), ("ran", "ran"), ("hoping", "hope"), ("hopping", "hop"), ("caresses", "caress"), ("cats", "cat"), ("ponies", "poni")],
)
def test_stems(word, want):
    assert stemmer.stem(word) == want


def test_measure():
    assert [stemmer.measure(w) for w in ("by", "trouble", "oops")] == [0, 1, 1]


def ms(*t):
    return int(datetime(*t, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(
    ("cron", "after", "want"),
    [
        ("0 3 * * *", (2024, 1, 1, 3, 0), (2024, 1, 2, 3, 0)),
        ("*/30 * * * *", (2024, 1, 1, 0, 1), (2024, 1, 1, 0, 30)),
        ("0 9 * * 1", (2024, 1, 2, 0, 0), (2024, 1, 8, 9, 0)),
        ("15,45 8-10 1 2 *", (2024, 1, 1, 0, 0), (2024, 2, 1, 8, 15)),
        ("0 0 29 2 *", (2023, 3, 1, 0, 0), (2024, 2, 29, 0, 0)),
    ],
)
def test_cron(cron, after, want):
    assert Cron.parse(cron).next_after(ms(*after)) == ms(*want)


def test_cron_keeps_seconds_and_ends():
    assert Cron.parse("* * * * *").next_after(ms(2024, 1, 1, 0, 0, 20)) == ms(2024, 1, 1, 0, 1, 20)
    assert Cron.parse("0 0 31 2 *").next_after(ms(2024, 1, 1)) is None
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "a * * * *", "* * 1-3 * *"):
        with pytest.raises(CronError):
            Cron.parse(bad)


def test_next_fire_column(spark):
    df = spark.createDataFrame([("0 3 * * *", 0), ("bad", 0), (None, 0)], "e string, t long")
    assert [r[0] for r in df.select(next_fire("e", "t")).collect()] == [3 * 3600 * 1000, None, None]


def test_merkle():
    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]
    root = merkle.root(leaves)
    assert root == merkle.parent(merkle.parent(merkle.parent(*leaves[:2]), merkle.parent(*leaves[2:4])), leaves[4])
    for i, leaf in enumerate(leaves):
        assert merkle.verify(leaf, merkle.proof(leaves, i), root)
        assert not merkle.verify(leaves[i - 1], merkle.proof(leaves, i), root)
    assert merkle.root([]) == hashlib.sha256(b"").hexdigest()
    assert merkle.proof(leaves, 9) == []


def one(spark, c):
    return spark.range(1).select(c).head()[0]


def test_division_and_casts(spark):
    df = spark.createDataFrame([(7, -7, 2, 2.0)], "a long, b long, c long, d double")
    got = df.select(scalar.divide(df, "a", "c"), scalar.divide(df, "b", "c"), scalar.divide(df, "a", "d")).head()
    assert tuple(got) == (3, -3, 3.5)
    assert one(spark, scalar.cast_to(F.lit(3.0), "double", "string")) == "3"
    assert one(spark, scalar.cast_to(F.lit("Yes"), "string", "boolean")) is True
    assert one(spark, scalar.cast_to(F.lit("42"), "string", "bigint")) == 42
    assert one(spark, scalar.cast_to(F.lit(None).cast("string"), "string", "bigint")) is None
    for bad in (scalar.cast_to(F.lit(" 42"), "string", "bigint"), scalar.cast_to(F.lit("t"), "string", "boolean")):
        with pytest.raises(Exception):
            one(spark, bad)
    with pytest.raises(TypeError):
        scalar.cast_to(F.lit(1.0), "double", "boolean")


def test_like_and_glob(spark):
    assert one(spark, scalar.like(F.lit("a\\b"), "a\\b")) is True
    assert one(spark, scalar.like(F.lit("100%"), "100\\%")) is True
    assert one(spark, scalar.like(F.lit("testXdata"), "test\\_data")) is False
    assert one(spark, scalar.like(F.lit("a\nb"), "a%b")) is True
    assert one(spark, scalar.ilike(F.lit("HELLO"), "hel%")) is True
    assert one(spark, scalar.glob_match(F.lit("user:1.x"), "user:?.*")) is True
    assert one(spark, scalar.glob_match(F.lit("user:1x"), "user:1.x")) is False


def test_small_helpers(spark):
    assert one(spark, scalar.nfc(F.lit("é"))) == "é"
    assert scalar.crc32c_bytes(b"123456789") == 0xE3069283
    assert one(spark, scalar.crc32c(F.lit(b"123456789"))) == 0xE3069283
    assert one(spark, scalar.json_get(F.lit('{"a": {"b": 5}}'), ["a", "b"])) == "5"
    assert one(spark, scalar.two_valued(F.lit(None).cast("boolean"))) is False
    assert scalar.unify("bigint", "double") == "double" and scalar.unify("void", "string") == "string"
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert df.agg(scalar.count_all("a", "b")).head()[0] == 3
    assert [r.b for r in df.orderBy(scalar.ascending("b")).collect()] == [3, None]
    assert [r.b for r in df.orderBy(scalar.descending("b")).collect()] == [None, 3]
    s = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("y")).alias("x")).alias("s"))
    assert s.select(scalar.get_path("s", "x.y")).head()[0] == 1
    assert s.select(scalar.set_path("s", "x.z", F.lit(2)).alias("s")).select("s.x.z").head()[0] == 2
