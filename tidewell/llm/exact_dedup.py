"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Each document becomes a digest (SHA-256, byte length and a second 64-bit hash
of the normalised text, so that equal digests are verified at every level).
Rows are dealt to ``runs`` runs; in binomial rounds run 2k and run 2k + 1 are
exchanged and merged, until one is left. Every round sorts what a task holds by
digest, folds equal neighbours (a sort aggregate), deals the sorted runs by
(digest, run), and merges what arrives in digest order: per digest the identifier
that stays and the number of copies. A digest that holds a third of all rows
never meets in one task: it is at most one row per task and run. In the last join,
digests with many copies (a bounded number) are broadcast.

Defined results: null text counts as empty; null ids take part in the count but
never stay unless a group has no other id; repeated rows with the id that stays
are all kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, attach, materialize, table, without_rows

KEY = ["digest", "n_bytes", "check"]


def normalised(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, digest, n_bytes, check) per document; the text goes no further."""
    lean = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return lean.select(
        "id", F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check")
    )


def merge_runs(found: DataFrame, keep: str = "max", runs: int = 16, fanout: int = 2) -> DataFrame:
    """Merge sorted runs of digests, ``fanout`` neighbours at a time, until one is left.

    The identifier is kept in a struct: such a buffer makes Spark aggregate sorted
    rows, so that each round is a sort, a fold and a merge in digest order.
    """
    best = {"max": F.max, "min": F.min}[keep]
    no_id = {"max": F.col("id").isNotNull(), "min": F.col("id").isNull()}[keep]  # null ids come last
    level = found.select(
        *KEY, F.struct(no_id.alias("rank"), "id").alias("stays"), F.lit(1).cast("long").alias("group_size"),
        F.pmod(F.xxhash64("id", "digest"), F.lit(runs)).alias("run")
    )
    while True:
        level = level.groupBy(*KEY, "run").agg(best("stays").alias("stays"), F.sum("group_size").alias("group_size"))
        if runs == 1:
            return level.select(*KEY, F.col("stays.id").alias("keep_id"), "group_size")
        runs = -(-runs // fanout)
        level = level.withColumn("run", F.floor(F.col("run") / F.lit(fanout)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = 16, fanout: int = 2) -> DataFrame:
    """Per document: id, keep_id, group_size, kept, digest, check (see the module)."""
    found = materialize(digests(docs, id_col, text_col), "digests")
    merged = materialize(merge_runs(found, keep, runs, fanout), "merged")
    hot = merged.filter(F.col("group_size") > max(1000, found.count() // 20_000)).select(*KEY)
    out = attach(found, merged, KEY, hot=materialize(hot, "hot"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "check")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by id and text, so that an id that comes with several texts
    loses only those that another row keeps.
    """
    dropped = exact_dedup(docs, id_col, text_col, keep).filter("not kept").select(F.col(id_col).alias("id"), "check").distinct()
    return without_rows(docs, materialize(dropped, "dropped"), id_col, F.xxhash64(normalised(text_col)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
