"""Session factory and table registration."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(app: str = "brindle", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the engine's semantics rely on.

    ANSI mode (errors on overflow and division by zero), a UTC session zone and AQE.
    On a cluster ``master`` and ``shuffle_partitions`` stay unset: they come from
    spark-submit, and AQE coalesces what is too fine.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for what a query writes: in spark.checkpoint.dir, or in a temporary folder that local runs remove at their end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Reads tables lazily and registers each as a temp view of its name."""
    out = {}
    for name in names or TABLES:
        out[name] = table(spark, sf_dir, name)
        out[name].createOrReplaceTempView(name)
    return out
