"""Tables with constraints and functional INSERT, UPDATE and DELETE, kept as Parquet snapshots.

Spark neither enforces NOT NULL, UNIQUE or PRIMARY KEY on Parquet nor updates it, so a statement plans the next
state of the table from one version, checks it, and publishes it as the next version: all of a statement happens or none of
it, and a statement whose version has been overtaken by another writer is refused (StaleTable). A version lists the folders of its
rows: an INSERT adds one and reads of the others their keys alone, UPDATE and DELETE write the rows anew. Older folders
stay for readers that still hold them until vacuum().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names and what they stand for.
TYPE_ALIASES = {
    "int": "bigint", "integer": "bigint", "tinyint": "bigint", "smallint": "bigint", "mediumint": "bigint", "bigint": "bigint",
    "float": "double", "double": "double", "real": "double", "decimal": "double", "numeric": "double",
    "text": "string", "varchar": "string", "string": "string", "char": "string", "tinytext": "string", "mediumtext": "string", "longtext": "string",
    "bool": "boolean", "boolean": "boolean", "bit": "boolean",
    "timestamp": "string", "datetime": "string", "date": "string", "time": "string", "year": "string",
    "blob": "string", "binary": "string", "varbinary": "string",
}


class ConstraintError(ValueError):
    pass


class TableError(ValueError):
    pass


class StaleTable(TableError):
    """Another writer published a version since the statement was planned; the table is as that writer left it."""


@dataclass(frozen=True)
class Col:
    """default: a SQL expression, current_timestamp() included. check: a boolean SQL expression over the row."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    unique: bool = False
    primary_key: bool = False
    auto_increment: bool = False
    check: str | None = None

    @property
    def spark_type(self) -> str:
        if self.type.lower() not in TYPE_ALIASES:
            raise TableError(f"unknown type {self.type}")
        return TYPE_ALIASES[self.type.lower()]


# ---- plans over plain DataFrames


def updated(df: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    """All assignments see the old row."""
    if extra := set(sets) - set(df.columns):
        raise TableError(f"no columns {sorted(extra)}")
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    kinds = dict(df.dtypes)
    return df.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in sets else F.col(c) for c in df.columns])


def deleted(df: DataFrame, where: Column | None = None) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False))) if where is not None else df.limit(0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their count; a key with a null is equal to none."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken(df: DataFrame, cols: list[Col]) -> DataFrame:
    """One row: how many rows break each NOT NULL and CHECK, in one pass."""
    counts = [F.lit(0).alias("_none")]
    for c in cols:
        if not c.nullable or c.primary_key:
            counts.append(F.count_if(F.col(c.name).isNull()).alias(f"{c.name}: null"))
        if c.check:
            counts.append(F.count_if(~F.coalesce(F.expr(c.check), F.lit(True))).alias(f"{c.name}: check {c.check}"))
    return df.agg(*[x if i else F.max(x).alias("_none") for i, x in enumerate(counts)])


class TableStore:
    """Tables under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files, by Hadoop's file system, so any store that Spark writes will do

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _meta_path(self, name: str) -> str:
        return f"{self.path}/{name}/_meta"

    def _versions(self, name: str) -> list[str]:
        fs, p = self._fs(self._meta_path(name))
        if not fs.exists(p):
            raise TableError(f"no table {name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def _meta(self, name: str, version: str | None = None) -> dict:
        version = version or self._versions(name)[-1]
        return json.loads(self.spark.read.text(f"{self._meta_path(name)}/{version}", wholetext=True).head()[0])

    def _publish(self, name: str, meta: dict) -> None:
        """One small file; its name's order makes it the current version, and creating it fails if another did so first."""
        fs, p = self._fs(f"{self._meta_path(name)}/v{meta['version']:012d}")
        if fs.exists(p):
            raise StaleTable(f"{name} has been changed since version {meta['version'] - 1}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            raise StaleTable(f"{name} has been changed since version {meta['version'] - 1}") from e
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()

    # -- catalogue

    def tables(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._fs(self._meta_path(s.getPath().getName()))[1])) if fs.exists(p) else []

    def schema(self, name: str) -> list[Col]:
        return [Col(**c) for c in self._meta(name)["cols"]]

    def read(self, name: str, meta: dict | None = None) -> DataFrame:
        """The rows of the current version, or of that in meta."""
        meta = meta or self._meta(name)
        kinds = ", ".join(f"`{c['name']}` {Col(**c).spark_type}" for c in meta["cols"])
        if not meta["data"]:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*meta["data"])

    def register(self, name: str) -> None:
        self.read(name).createOrReplaceTempView(name)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def create(self, name: str, cols: list[Col]) -> None:
        fs, p = self._fs(self._meta_path(name))
        if fs.exists(p):
            raise TableError(f"{name} exists")
        for c in cols:
            c.spark_type  # noqa: B018  an unknown type is an error
        self._publish(name, {"version": 1, "cols": [asdict(c) for c in cols], "data": [], "change": {"kind": "created", "rows": 0}})
        self.register(name)

    def drop(self, name: str) -> None:
        self._meta(name)
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)
        self.spark.catalog.dropTempView(name)

    def changes(self, name: str) -> list[dict]:
        """The log of what was done, a version after the other: kind and rows of each statement."""
        return [self._meta(name, v)["change"] for v in self._versions(name)]

    def vacuum(self, name: str) -> int:
        """Removes the folders that the current version doesn't list, those of refused statements included; how many."""
        held = {d.rsplit("/", 1)[1] for d in self._meta(name)["data"]}
        fs, p = self._fs(f"{self.path}/{name}")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in held]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    # -- statements

    def _commit(self, name: str, meta: dict, df: DataFrame, kind: str, rows: int, onto: bool = False) -> int:
        """Publishes the version after meta, with the rows of df; onto: in addition to those of meta."""
        cols = [Col(**c) for c in meta["cols"]]
        data = f"{self.path}/{name}/data-{uuid.uuid4().hex}"
        df.write.parquet(data)
        new = self.read(name, meta | {"data": [data]})
        bad = {k: v for k, v in broken(new, cols).head().asDict().items() if v}
        for c in cols:
            if c.unique or c.primary_key:
                if twice := duplicate_keys(new, [c.name]).head():
                    bad[f"{c.name}: {twice[0]!r} isn't unique"] = twice.n
                elif onto and meta["data"] and (twice := self.read(name, meta).select(c.name).join(new.select(c.name), c.name, "left_semi").head()):
                    bad[f"{c.name}: {twice[0]!r} isn't unique"] = 1
        try:
            if bad:
                raise ConstraintError("; ".join(bad))
            every = [*meta["data"], data] if onto else [data]
            self._publish(name, meta | {"version": meta["version"] + 1, "data": every, "change": {"kind": kind, "rows": rows}})
        except (ConstraintError, StaleTable):
            fs, p = self._fs(data)
            fs.delete(p, True)
            raise
        self.register(name)
        return rows

    def insert(self, name: str, rows: DataFrame) -> int:
        """Missing columns get their default; all rows go in or none."""
        meta = self._meta(name)
        cols = [Col(**c) for c in meta["cols"]]
        if extra := set(rows.columns) - {c.name for c in cols}:
            raise TableError(f"no columns {sorted(extra)}")
        out = rows
        for c in cols:
            if c.auto_increment and c.name not in rows.columns:
                start = self.read(name, meta).agg(F.coalesce(F.max(c.name), F.lit(0))).head()[0]
                out = self._numbered(name, out, c.name, start + 1)
            elif c.name not in rows.columns:
                out = out.withColumn(c.name, F.expr(c.default) if c.default else F.lit(None))
        out = out.select(*[F.col(c.name).cast(c.spark_type).alias(c.name) for c in cols])
        return self._commit(name, meta, out, "insert", rows.count(), onto=True)

    def _numbered(self, name: str, rows: DataFrame, col: str, first: int) -> DataFrame:
        """rows with gapless numbers from first, by the counts of their partitions; written once, so numbers don't change."""
        staged = f"{self.path}/{name}/data-{uuid.uuid4().hex}"
        rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged).withColumn("_p", F.shiftright("_at", 33))
        begin = []
        for p, n in sorted(rows.groupBy("_p").agg(F.count(F.lit(1))).collect()):
            begin.append((p, first))
            first += n
        starts = self.spark.createDataFrame(begin, "_p long, _first long")
        number = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        return rows.join(F.broadcast(starts), "_p").withColumn(col, number).drop("_p", "_at", "_first")

    def update(self, name: str, sets: dict[str, Column], where: Column | None = None) -> int:
        meta = self._meta(name)
        df = self.read(name, meta)
        n = df.where(where).count() if where is not None else df.count()
        return self._commit(name, meta, updated(df, sets, where), "update", n)

    def delete(self, name: str, where: Column | None = None) -> int:
        meta = self._meta(name)
        df = self.read(name, meta)
        n = df.where(where).count() if where is not None else df.count()
        return self._commit(name, meta, deleted(df, where), "delete", n)
