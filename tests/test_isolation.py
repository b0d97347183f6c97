"""Isolation forest: many rows, and both ways to score."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import outliers


def test_isolation_forest_of_many_rows(spark):
    """Rows times 2^40 are beyond a long from 8.4 million rows on."""
    df = spark.range(0, 9_000_000, 1, 8).select("id", (F.col("id") % 1013).cast("double").alias("a"))
    assert outliers.isolation_forest(df, ["a"], ["id"], trees=2, size=16).filter("score IS NULL").count() == 0


@pytest.mark.parametrize("cells", [0, 1 << 15])
def test_isolation_scores_by_table_and_by_walking(spark, monkeypatch, cells):
    df = spark.createDataFrame(pd.DataFrame({"i": range(500), "a": np.arange(500.0) % 37, "b": np.arange(500.0) ** 2 % 101}))
    want = {r["i"]: r["score"] for r in outliers.isolation_forest(df, ["a", "b"], ["i"], 10, 32).collect()}
    monkeypatch.setattr(outliers, "TREE_CELLS", cells)
    got = {r["i"]: r["score"] for r in outliers.isolation_forest(df, ["a", "b"], ["i"], 10, 32).collect()}
    assert got == want and len(set(got.values())) > 10
