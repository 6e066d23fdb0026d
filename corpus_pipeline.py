"""From raw documents to packed token sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

Defined results, of every stage: a null text is an empty one; null and repeated ids are fine, and rows that repeat are treated
alike; an empty table gives an empty one; columns besides doc_id, text, lang, source and n_chars pass through
untouched, whatever their names, but for the last stage, which drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, line_dedup, near_dedup, packing, quality
from brindle.llm.common import materialize

KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _changed(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs) with the columns of docs, n_chars following the text. The operator sees other columns by names that it doesn't use."""
    names = {c: c if c in KNOWN else f"other{i}" for i, c in enumerate(docs.columns)}
    out = operator(docs.toDF(*names.values()))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(new).alias(old) for old, new in names.items()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or consist of their host's boilerplate lines go; from the others those lines go. A null text fails."""
    return _changed(docs, quality.keep_good)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them only."""
    return _changed(docs, lambda d: line_dedup.drop_lines(d).drop("n_lines", "n_dropped"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays; texts without words are like none but those that repeat them with their id."""
    return _changed(docs, near_dedup.keep_one)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _changed(docs, lambda d: decontaminate.keep_clean(d, benchmark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 2048 tokens; an empty text is one end token."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs.select("doc_id", "text"), packing.word_ids(path))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: No SQL: near-duplicate components and tokenising can't be written in it; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
