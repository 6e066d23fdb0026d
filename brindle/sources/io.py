"""Sources and sinks. Formats are Spark's own; columns and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(*paths)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """The schema is given, as inferring it would read everything twice."""
    return spark.read.schema(schema).csv(path, header=header)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length and content of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database, read in parts by ranges of an integer key if one is given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        r = r.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return r.load()


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists", codec: str = "zstd", bloom: list[str] | None = None) -> None:
    """bloom: columns that get Bloom filters, for point lookups that skip row groups."""
    w = df.write.mode(mode).option("compression", codec)
    for c in bloom or []:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], parts: int | None = None, codec: str = "zstd") -> None:
    """Range-partitioned and sorted by key: key ranges and points then read few row groups."""
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    write_parquet(ranged.sortWithinPartitions(*keys), path, codec=codec)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table whose later joins and aggregates by these keys need no shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)


def as_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, keyed by column."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def envelope(df: DataFrame, limit: int) -> dict:
    """columns, types, rows and row_count of at most ``limit`` rows, for a caller that wants them at once."""
    rows = df.limit(limit).collect()
    return {"columns": df.columns, "types": [t for _, t in df.dtypes], "rows": [list(r) for r in rows], "row_count": len(rows)}
