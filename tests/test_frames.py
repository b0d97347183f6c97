"""Window frames that grow with the square of a partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import series, steps


def test_no_frame_ends_with_its_partition(spark):
    """Such a frame is gone through anew for every row."""
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (1, 4, 9.0), (1, 5, None)], "k int, pos long, value double")
    filled = {
        "linear": series.interpolate(df.withColumn("ts", F.lit(None).cast("timestamp")), ["k"]), "ranges": steps.fill(df, "value", "bfill", order_by="pos"),
        "parts": steps.fill(df, "value", "bfill", order_by="pos", partition_by=["k"])
    }
    want = {"linear": [5.0, 5.0, 7.0, 9.0, 9.0], "ranges": [5.0, 5.0, 9.0, 9.0, None], "parts": [5.0, 5.0, 9.0, 9.0, None]}
    for kind, out in filled.items():
        assert [r["value"] for r in out.orderBy("pos").collect()] == want[kind]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "currentrow$(), unboundedfollowing$()" not in plan
