"""What the operators share: where cut lineage goes, and how texts become words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local runs where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() gave and nothing reads any more, frames made of them included."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, tag: str, key: list[str]) -> DataFrame:
    """As materialize(), dealt by key into as many buckets as shuffles have partitions and sorted by it: joins on key need no exchange of it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"brindle_{tag}_{uuid.uuid4().hex}"
    out = df.repartition(n, *key).write.format("parquet").option("path", f"{shared_dir(spark).rstrip('/')}/{name}")
    out.bucketBy(n, *key).sortBy(*key).saveAsTable(name)
    return spark.table(name)


SALTS = 16


def _salt(own: str) -> Column:
    return F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")


def salts(own: str) -> Column:
    """An aggregate for the groups that join_hot() gives back to their rows: which salts the rows have."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), _salt(own))).alias("_salts")


def join_hot(rows: DataFrame, groups: DataFrame, key: list[str], own: str, hint: str | None = None) -> DataFrame:
    """rows joined with groups (key, _salts of the rows, more), SALTS tasks for a key that very many rows have.

    A group goes only to the salts that its rows have, so a group of n rows is sent min(n, SALTS) times at most.
    """
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("_salts", i) == 1)).alias("_salt")
    groups = groups.select("*", each).drop("_salts")
    groups = groups.hint(hint) if hint else groups
    return rows.withColumn("_salt", _salt(own)).join(groups, [*key, "_salt"]).drop("_salt")


#: The bit map of join_few() has at most 2 to this power bits (2 MB; about 10 MB as a broadcast table).
MAP_BITS = 24


def join_few(rows: DataFrame, few: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with few (read more than once) by key, which has no nulls; how: left, left_anti or inner.

    A bit map of few's keys, of 16 bits a key and more up to MAP_BITS, rules out most rows without a match: they stay where
    they are, the others are joined by key. Beyond that size more rows are shuffled in vain, but none is joined wrongly.
    """
    bits = 1 << min(MAP_BITS, max(10, (16 * few.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    taken = few.select(word.alias("_map_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    taken = F.broadcast(taken.groupBy("_map_word").agg(F.bit_or("_bit").alias("_map_bits")))
    can = (word == F.col("_map_word")) & (F.getbit("_map_bits", bit) == 1)
    joined = rows.join(taken, can, "left_semi").join(few, key, how)
    return joined if how == "inner" else joined.unionByName(rows.join(taken, can, "left_anti"), allowMissingColumns=True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """The runs of other than ASCII white space, in order; an empty array where there is none."""
    bare = F.btrim(col, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def row_key(doc_id: str = "doc_id", text: str = "text", *more: str) -> Column:
    """128 bits that equal rows share: joins a document with what was found of it, null ids and repeated ids included."""
    given = [F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")), *map(F.col, more)]
    return F.struct(F.xxhash64(*given).alias("a"), F.xxhash64(F.lit(7), *given).alias("b"))


class TwoGenerations(dict):
    """A dict that makes missing values itself and never holds more than 2 x limit entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
