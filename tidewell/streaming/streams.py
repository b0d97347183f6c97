"""Structured Streaming: presence, incremental refresh, windowed counts, rules, sessions.

Event times are cast to timestamps for watermarks. Each stream operator has a
batch twin with the same result on the same rows, up to rows later than the
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.profile import missing_total, quality_score
from tidewell.operators.rules import quarantine

STALE = 35


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def presence_at(events: DataFrame, now: str, keys: list[str], user: str, place: str, ts: str = "ts", stale: int = STALE) -> DataFrame:
    """Batch twin: users whose last heartbeat is at most ``stale`` seconds old at ``now``, per place."""
    seen = events.filter(F.col(ts) <= F.lit(now).cast("timestamp_ntz"))
    last = seen.groupBy(*keys, user).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(place).alias("p"))).alias("x"))
    live = last.filter(F.col("x.t") >= F.expr(f"cast('{now}' as timestamp_ntz) - interval {stale} seconds"))
    return live.select(*keys, user, F.col("x.p").alias(place), F.col("x.t").cast("string").alias("last_seen"))


def presence_sessions(stream: DataFrame, keys: list[str], ts: str = "ts", stale: int = STALE, late: str = "1 minute") -> DataFrame:
    """Stream: spans of presence, each ended by ``stale`` seconds without a heartbeat."""
    e = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    return e.groupBy(F.session_window("__t", f"{stale} seconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("beats")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats"
    )


def sessions(events: DataFrame, keys: list[str], gap_seconds: int, ts: str = "ts") -> DataFrame:
    """Batch twin of session windows: a gap of ``gap_seconds`` or more starts a new session."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    s = events.withColumn("__new", F.coalesce((gap >= gap_seconds).cast("int"), F.lit(1))).withColumn(
        "session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return s.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def counts_per_window(
    stream: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour", by: list[str] | None = None, key: str | None = None
) -> DataFrame:
    """Tumbling counts; rows later than the watermark are dropped, repeated ``key`` within it too."""
    e = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    if key:
        e = e.dropDuplicatesWithinWatermark([key])
    return e.groupBy(F.window("__t", width).alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *(by or []), "n")


def rules_on_stream(stream: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that break a row-wise rule, for a quarantine sink."""
    return quarantine(stream, rules)


def refresh(stream: DataFrame, runs_path: str, checkpoint: str, dataset_id: int = 0):
    """One run-history row per batch of new files; returns the started query."""

    def batch(df: DataFrame, number: int) -> None:
        q = quality_score(df).select("overall").crossJoin(F.broadcast(missing_total(df).select("missing_pct"))).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("row_count"))))
        q.select(
            F.lit(dataset_id).alias("dataset_id"), F.lit(number).alias("batch"), "row_count", F.col("overall").alias("quality_score"), "missing_pct"
        ).write.mode("append").parquet(runs_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append"):
    """Write what is there now as Parquet and stop."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
