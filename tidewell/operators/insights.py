"""Insight rows (source, message, severity) from result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, source: str, *rules: tuple[Column, str, tuple, str]) -> DataFrame:
    """rules: (condition, format, columns, severity)."""
    made = [
        F.when(when, F.struct(F.lit(source).alias("source"), F.format_string(text, *args).alias("message"), F.lit(severity).alias("severity"))) for when,
        text, args, severity in rules
    ]
    return df.select(F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.*")


def from_profile(profile: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    m = F.col("missing_pct")
    out = _rows(
        profile, "profile",
        (m > 50, "%s: %.1f%% missing", ("column_name", "missing_pct"), "critical"), (
            (m > 20) & (m <= 50), "%s: %.1f%% missing", ("column_name", "missing_pct"), "warning"
        ),
        (F.abs("skewness") > 2, "%s: skewness %.2f", ("column_name", "skewness"), "info"), (
            F.col("semantic_type") == "constant", "%s is constant", ("column_name",), "warning"
        ),
        (F.col("semantic_type") == "id_like", "%s looks like an identifier", ("column_name",), "info"),
    )
    if duplicates is None:
        return out
    return out.unionByName(_rows(duplicates, "profile", (F.col("duplicate_pct") > 5, "%.1f%% duplicate rows", ("duplicate_pct",), "warning")))


def from_distribution(row: DataFrame) -> DataFrame:
    """row: column_name, p, skewness."""
    return _rows(
        row, "distribution", (F.col("p") <= 0.05, "%s is not normal (p = %.4f)", ("column_name", "p"), "info"),
        (F.col("p") > 0.05, "%s may be normal (p = %.4f)", ("column_name", "p"), "info"),
        (F.abs("skewness") > 2, "%s: skewness %.2f", ("column_name", "skewness"), "warning")
    )


def from_correlations(pairs: DataFrame, vif: DataFrame | None = None) -> DataFrame:
    r = F.abs("r")
    out = _rows(
        pairs, "correlations", (r > 0.9, "%s and %s: r = %.2f", ("column_a", "column_b", "r"), "critical"),
        ((r > 0.7) & (r <= 0.9), "%s and %s: r = %.2f", ("column_a", "column_b", "r"), "warning")
    )
    if vif is None:
        return out
    return out.unionByName(_rows(
        vif, "correlations", (F.col("vif") > 10, "%s: VIF %.1f", ("column_name", "vif"), "critical"),
        ((F.col("vif") > 5) & (F.col("vif") <= 10), "%s: VIF %.1f", ("column_name", "vif"), "warning")
    ))


def from_outliers(fences: DataFrame) -> DataFrame:
    p = F.col("pct")
    return _rows(
        fences, "outliers", (p > 10, "%s: %.1f%% outliers", ("column_name", "pct"), "critical"),
        ((p > 3) & (p <= 10), "%s: %.1f%% outliers", ("column_name", "pct"), "warning")
    )


def from_quality(score: DataFrame) -> DataFrame:
    o = F.col("overall")
    return _rows(
        score, "quality", (o < 60, "quality %d: poor", ("overall",), "critical"), ((o >= 60) & (o < 80), "quality %d: fair", ("overall",), "warning"),
        (o >= 80, "quality %d: good", ("overall",), "info")
    )


def from_timeseries(stationarity: DataFrame, anomalies: DataFrame, key: str) -> DataFrame:
    """stationarity: key, verdict; anomalies: key, anomaly."""
    n = anomalies.groupBy(key).agg(F.count_if("anomaly").alias("n"))
    a = _rows(
        stationarity, "timeseries", (F.col("verdict") == "non_stationary", "%s is not stationary", (key,), "warning"),
        (F.col("verdict") == "stationary", "%s is stationary", (key,), "info")
    )
    return a.unionByName(_rows(n, "timeseries", (F.col("n") > 0, "%s: %d anomalies", (key, "n"), "warning")))


def from_missing(total: DataFrame, table: DataFrame, mechanism: DataFrame | None = None) -> DataFrame:
    """Overall share, columns, and columns whose gaps go with other columns."""
    t, c = F.col("missing_pct"), F.col("missing_pct")
    out = _rows(
        total, "missing", (t > 30, "%.1f%% of cells missing", ("missing_pct",), "critical"),
        ((t > 10) & (t <= 30), "%.1f%% of cells missing", ("missing_pct",), "warning")
    )
    out = out.unionByName(_rows(
        table, "missing", (c > 80, "%s: %.1f%% missing", ("column_name", "missing_pct"), "critical"),
        ((c > 40) & (c <= 80), "%s: %.1f%% missing", ("column_name", "missing_pct"), "warning")
    ))
    if mechanism is not None:
        out = out.unionByName(_rows(mechanism, "missing", (F.col("mechanism") == "MAR", "%s: gaps go with %s", ("column_name", "related"), "info")))
    return out


def from_importance(found: DataFrame, problem: DataFrame, leaks: DataFrame) -> DataFrame:
    """found: feature, importance, mi."""
    top = found.orderBy(F.col("importance").desc(), "feature").limit(1)
    low = found.agg(F.count_if(F.col("importance") < 0.01).alias("n"))
    out = _rows(top, "importance", (F.lit(True), "%s matters most (%.3f)", ("feature", "importance"), "info"))
    out = out.unionByName(_rows(low, "importance", (F.col("n") > 3, "%d features matter little", ("n",), "warning")))
    out = out.unionByName(_rows(found, "importance", (F.col("mi") > 0.5, "%s: mutual information %.2f", ("feature", "mi"), "info")))
    out = out.unionByName(_rows(leaks, "importance", (F.col("strength") > 0.95, "%s may leak the target (%.2f)", ("feature", "strength"), "critical")))
    return out.unionByName(_rows(problem, "importance", (F.lit(True), "problem: %s", ("problem_type",), "info")))


def from_text(overview: DataFrame, mood: DataFrame | None = None, pii: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Insights on a text column from its tables."""
    out = _rows(
        overview, "text",
        (F.col("missing_pct") > 20, "%.1f%% missing", ("missing_pct",), "warning"), (F.col("blank_pct") > 10, "%.1f%% blank", ("blank_pct",), "warning"), (
            F.col("duplicates_pct") > 30, "%.1f%% duplicates", ("duplicates_pct",), "warning"
        ),
        (F.col("mean_length") < 10, "short texts, %.1f characters", ("mean_length",), "info"), (
            F.col("mean_length") > 5000, "long texts, %.1f characters", ("mean_length",), "info"
        ),
    )
    if mood is not None:
        all_ = F.col("positive") + F.col("negative") + F.col("neutral")
        m = mood.withColumns({"p": 100.0 * F.try_divide(F.col("positive"), all_), "n": 100.0 * F.try_divide(F.col("negative"), all_)})
        out = out.unionByName(_rows(m, "text", (F.col("p") > 85, "%.1f%% positive", ("p",), "info"), (F.col("n") > 85, "%.1f%% negative", ("n",), "warning")))
    if pii is not None:
        out = out.unionByName(_rows(pii, "text", (F.col("matches") > 0, "%d matches of %s", ("matches", "kind"), "critical")))
    if words is not None:
        out = out.unionByName(_rows(words, "text", (F.col("type_token_ratio") < 0.05, "type-token ratio %.3f", ("type_token_ratio",), "info")))
    return out
