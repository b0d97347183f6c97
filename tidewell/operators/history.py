"""Run history, monitoring and collaboration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = "dataset_id long, run_at timestamp, row_count long, col_count int, quality_score int, missing_pct double, triggered_by string"


def record_run(df: DataFrame, dataset_id: int, path: str, triggered_by: str = "user") -> DataFrame:
    """Append one row about ``df`` to the run table at ``path``, and return it."""
    from tidewell.operators.profile import missing_total, quality_score

    q = quality_score(df).select("overall").crossJoin(F.broadcast(missing_total(df).select("missing_pct"))).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))
    row = q.select(
        F.lit(dataset_id).cast("long").alias("dataset_id"), F.current_timestamp().alias("run_at"), F.col("n").alias("row_count"),
        F.lit(len(df.columns)).alias("col_count"), F.col("overall").alias("quality_score"), "missing_pct", F.lit(triggered_by).alias("triggered_by")
    )
    row.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def newest(runs: DataFrame, dataset_id: int | None = None, limit: int = 50) -> DataFrame:
    rows = runs if dataset_id is None else runs.filter(F.col("dataset_id") == dataset_id)
    return rows.orderBy(F.col("run_at").desc(), F.col("row_count").desc()).limit(limit)


def latest(runs: DataFrame) -> DataFrame:
    """The last run of each dataset, by aggregation: a dataset with a third of all runs combines first."""
    rest = [c for c in runs.columns if c != "dataset_id"]
    return runs.groupBy("dataset_id").agg(F.max(F.struct("run_at", *(c for c in rest if c != "run_at"))).alias("r")).select(
        "dataset_id", *(F.col(f"r.{c}").alias(c) for c in rest)
    )


def trend(runs: DataFrame) -> DataFrame:
    """Rows (dataset_id, run_at, quality_score, change)."""
    w = Window.partitionBy("dataset_id").orderBy("run_at", "row_count")
    return runs.select("dataset_id", "run_at", "row_count", "quality_score", (F.col("quality_score") - F.lag("quality_score").over(w)).alias("change"))


def worst(last: DataFrame) -> DataFrame:
    """One row (worst_quality, most_missing): null quality counts as 100, null missing as 0; ties by id."""
    q, m = F.coalesce("quality_score", F.lit(100)), F.coalesce("missing_pct", F.lit(0.0))
    return last.agg(
        F.min_by("dataset_id", F.struct(q, F.col("dataset_id"))).alias("worst_quality"),
        F.max_by("dataset_id", F.struct(m, -F.col("dataset_id"))).alias("most_missing")
    )


def enrich(parents: DataFrame, comments: DataFrame, votes: DataFrame, user: int) -> DataFrame:
    """Parents (id) with comment and vote counts and whether ``user`` voted. comments: parent_id, is_system; votes: parent_id, user_id."""
    c = comments.filter("NOT is_system").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("comments"))
    v = votes.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("votes"), F.max((F.col("user_id") == user).cast("int")).alias("own"))
    out = parents.join(c, "id", "left").join(v, "id", "left")
    return out.withColumns({
        "comments": F.coalesce("comments", F.lit(0)), "votes": F.coalesce("votes", F.lit(0)), "own": F.coalesce(F.col("own") == 1, F.lit(False))
    })


def reactions(comments: DataFrame, votes: DataFrame, authors: DataFrame) -> DataFrame:
    """Comments (id, author_id, at) with likes and dislikes (votes: id, kind) and the author's name, in time order."""
    v = votes.groupBy("id").agg(F.count_if(F.col("kind") == "like").alias("likes"), F.count_if(F.col("kind") == "dislike").alias("dislikes"))
    out = comments.join(authors.select(F.col("id").alias("author_id"), "name"), "author_id").join(v, "id", "left")
    return out.withColumns({"likes": F.coalesce("likes", F.lit(0)), "dislikes": F.coalesce("dislikes", F.lit(0))}).orderBy("at", "id")


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(html) -> F.Column:
    """Text of an HTML fragment: tags to spaces, common references decoded."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def mentions(html) -> F.Column:
    """Distinct @mentions of up to three capitalised words."""
    return F.array_distinct(F.regexp_extract_all(plain(html), F.lit(r"@(\p{Lu}[\p{L}\p{N}_.-]*(?: \p{Lu}[\p{L}\p{N}_.-]*){0,2})"), 1))


def preview_text(html, length: int = 160) -> F.Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")), 1, length)


def articles(items: DataFrame, attachments: DataFrame, links: DataFrame, datasets: DataFrame) -> DataFrame:
    """Articles (id) with the number of attachments and the names of linked datasets, sorted."""
    a = attachments.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("attachments"))
    d = links.join(
        datasets.select(F.col("id").alias("dataset_id"), "name"), "dataset_id"
    ).groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("datasets"))
    return items.join(a, "id", "left").join(d, "id", "left").withColumns({
        "attachments": F.coalesce("attachments", F.lit(0)), "datasets": F.coalesce("datasets", F.array().cast("array<string>"))
    })


def delete_children_first(tables: list[tuple[str, DataFrame, str, str | None]], keys: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table after deleting ``keys`` (one column ``key``) from the first.

    tables: (name, rows, id column, parent column) from parent to children; each child
    loses the rows whose parent goes, by an anti join.
    """
    left, gone = {}, keys.select("key")
    for i, (label, rows, id_col, parent) in enumerate(tables):
        on = F.col(id_col) == F.col("key") if i == 0 else F.col(parent) == F.col("key")
        left[label] = rows.join(gone, on, "left_anti")
        gone = rows.join(gone, on, "left_semi").select(F.col(id_col).alias("key")).distinct()
    return left
