"""Upper case by code point."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.functions.cleaning import upper


def test_upper_case_keeps_lengths(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["Straße\nﬁn ŉ", "ß", "", "ab\U0001f600ß\U0001f600c", "ᾳ ᾀ ῲ", None, "plain é"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(upper(F.col("t"))).collect()]
    assert got == [duckdb.connect().execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]
