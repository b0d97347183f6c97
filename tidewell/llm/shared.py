"""What the corpus operators share: scratch tables, ASCII folding, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is empty and Spark runs in local mode (tests) a
    temporary folder is made, once per session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        found = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    This cuts lineage and makes what two branches need computed once; lost
    executors do not lose it.
    """
    bounded_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def bounded_batches(spark: SparkSession, most: str = "2m") -> None:
    """Bound Arrow batches by bytes, as rows are whole texts; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("64m", "67108864b", "64mb"):
        spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows, without counting beyond it."""
    return df.limit(bound + 1).count() <= bound


def semi_join_bounded(left: DataFrame, ids: DataFrame, on: str, bound: int = 400_000) -> DataFrame:
    """Left semi join that ships the ids only while their number is proven small.

    Up to ``bound`` ids (a few MB of longs) are broadcast, so that the wide left
    side is not shuffled; beyond it, Spark plans a shuffled join.
    """
    return left.join(F.broadcast(ids) if rows_within(ids, bound) else ids, on, "left_semi")


def anti_join_bounded(left: DataFrame, ids: DataFrame, on: str, bound: int = 400_000) -> DataFrame:
    """Left anti join with the same rule."""
    return left.join(F.broadcast(ids) if rows_within(ids, bound) else ids, on, "left_anti")


def without_rows(docs: DataFrame, dropped: DataFrame, id_col: str, check: Column, bound: int = 400_000) -> DataFrame:
    """The rows of ``docs`` whose id and ``check`` (a hash of the text) are not in ``dropped`` (id, check); same rule."""
    dropped = F.broadcast(dropped) if rows_within(dropped, bound) else dropped
    gone = F.col(f"kept_from.`{id_col}`").eqNullSafe(F.col("gone.id")) & (check == F.col("gone.check"))
    return docs.alias("kept_from").join(dropped.alias("gone"), gone, "left_anti")


def attach(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", share: int = 20_000, least: int = 1000, fits: Column | None = None,
    hot: DataFrame | None = None
) -> DataFrame:
    """Join ``left`` with the rows of ``right``, whose keys are unique, whatever the skew of the keys in ``left``.

    Keys that hold more than ``1 / share`` of the rows of ``left`` (and more than
    ``least``) can't be more than ``share``: their rows of ``right`` are broadcast, so
    that no such key meets in one task. All other rows are joined as Spark plans it.
    ``fits`` says which rows of ``right`` are small enough to be broadcast at all.
    """
    keys = [on] if isinstance(on, str) else list(on)
    hot = hot_keys(left, keys, share, least) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = right.join(F.broadcast(hot), keys, "left_semi")
    few = materialize(few if fits is None else few.filter(fits), "hot-rows")
    rest = left.join(F.broadcast(few.select(*keys).distinct()), keys, "left_anti")
    return left.join(F.broadcast(few), keys).unionByName(rest.join(right, keys, how))


def hot_keys(left: DataFrame, keys: list[str], share: int = 20_000, least: int = 1000) -> DataFrame:
    """The keys with more than ``1 / share`` of the rows and more than ``least``: at most ``share`` rows."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    bound = max(least, left.count() // share)
    return materialize(counts.filter(F.col("rows") > bound).select(*keys), "hot")


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Connected components: one row (node, component) per linked node.

    The component is the smallest node. Each round takes the minimum label of
    the neighbours and then follows labels once more, so that paths halve; it
    stops when no label changes. Labels are written out each round. Hubs and large
    components are joined by broadcast (see :func:`attach`).
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = materialize(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    hubs = hot_keys(edges, ["b"])
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = materialize(labels, f"{name}-0")
    while True:
        near = attach(edges, labels.withColumnRenamed("node", "b"), "b", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "node", "left").select("node", F.col("component").alias("before"), F.least("component", "m").alias("c"))
        hooked = materialize(hooked, f"{name}-hooked")
        parent = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        after = attach(hooked, parent, "c", "left").select("node", "before", F.least("c", "up").alias("component"))
        after = materialize(after, f"{name}-next")
        labels = after.select("node", "component")
        if after.filter("component <> before").isEmpty():
            return labels
