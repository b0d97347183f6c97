"""Ranks of many rows: no task sorts more than its share, however little the shuffle files weigh."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import ranks


def test_rank_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranks, "TASK_ROWS", 5000, raising=False)
    out = ranks.with_rank(spark.range(100_000).select((F.col("id") % 50_000).cast("double").alias("v")), "v", "r")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 15_000
