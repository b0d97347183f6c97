"""From raw documents to packed token windows in five stages.

Each stage takes what its predecessor kept and returns a DataFrame that is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``.

Defined results: stages decide by row, so rows that share an id keep their own texts;
null texts fail the base rules; rows with a null id are judged and cut like others, and
of their copies without any id all stay; ties are those of the operators; an empty
table runs through; extra columns, also with names the operators use, are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from tidewell.llm.shared import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike the trusted target go."""
    return quality.keep_good(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the row with the largest doc_id stays."""
    return exact_dedup.keep_first_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.keep_one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has too are cut out; n_chars follows."""
    cut = suffix_dedup.repeated_passages(docs, keep_rows=True)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; smaller blocks than by default, as executors have four stages behind them."""
    return packing.pack(docs, packing.default_tokenizer(), block_bytes=2 << 20, kept_words=250_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("packing", packed),
]

#: Hashed models, components and token windows can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
