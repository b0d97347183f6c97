"""Queries of group L (time series). Daily order sums, one series per order status."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import series as S

from .fixtures import t
from .registry import query

K = ["k"]
BASE = "b AS (SELECT o_orderstatus AS k, CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2), s AS (SELECT k, ts, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS pos, value FROM b)"
W = f"WITH {BASE} "
P = "PARTITION BY k ORDER BY pos"


def _daily(o):
    b = o.groupBy(F.col("o_orderstatus").alias("k"), F.to_date("o_orderdate").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return S.prepare(b, "ts", "value", K)


def series(spark, d):
    """The series of BASE: all orders."""
    return _daily(t(spark, d, "orders"))


def holes(spark, d):
    return series(spark, d).withColumn("value", F.when(F.col("pos") % 7 != 0, F.col("value")))


H = f"{W.rstrip()}, h AS (SELECT k, ts, pos, CASE WHEN pos % 7 <> 0 THEN value END AS value FROM s) "


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _d(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query("l01_prepare", f"{W}SELECT k, CAST(ts AS VARCHAR) AS ts, pos, value FROM s")
def l01(spark, d):
    return _d(series(spark, d), "ts")


@query(
    "l02_interpolate",
    f"{H.rstrip()}, x AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pa, last_value(value IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS va, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb, first_value(value IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM h) SELECT k, pos, round(coalesce(value, CASE WHEN pb > pa THEN va + (vb - va) / (pb - pa) * (pos - pa) END, va, vb), 3) AS value FROM x"
)
def l02(spark, d):
    return _r(S.interpolate(holes(spark, d), K), 3, "value").select("k", "pos", "value")


_ST = "st AS (SELECT *, CAST(date_diff('second', lag(ts) OVER (PARTITION BY k ORDER BY pos), ts) AS BIGINT) AS step, lag(ts) OVER (PARTITION BY k ORDER BY pos) AS before FROM h), m AS (SELECT k, step AS modal_step FROM (SELECT k, step, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, step) AS r FROM st WHERE step IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"


@query(
    "l03_quality",
    f"{H.rstrip()}, {_ST} SELECT k, count(*) AS rows, round(100.0 * count(*) FILTER (WHERE value IS NULL) / count(*), 4) AS missing_pct, count(*) - count(DISTINCT ts) AS duplicate_times, count(*) FILTER (WHERE value = 0) AS zeros FROM st GROUP BY 1"
)
def l03(spark, d):
    return _r(S.quality(holes(spark, d), K), 4, "missing_pct").select("k", "rows", "missing_pct", "duplicate_times", "zeros")


@query(
    "l04_modal_step",
    f"{H.rstrip()}, {_ST} SELECT k, modal_step, round(100.0 * count(*) FILTER (WHERE step <> modal_step) / count(step), 4) AS irregular_pct FROM st JOIN m USING (k) GROUP BY 1, 2"
)
def l04(spark, d):
    return _r(S.quality(holes(spark, d), K), 4, "irregular_pct").select("k", "modal_step", "irregular_pct")


@query(
    "l05_frequency",
    f"{H.rstrip()}, {_ST} SELECT k, CASE WHEN modal_step < 60 THEN 's' WHEN modal_step < 3600 THEN 'min' WHEN modal_step < 86400 THEN 'h' WHEN modal_step < 86400 * 6 THEN 'D' WHEN modal_step < 86400 * 25 THEN 'W' ELSE 'M' END AS frequency FROM m"
)
def l05(spark, d):
    return S.quality(series(spark, d), K).select("k", "frequency")


@query(
    "l06_gaps",
    f"{H.rstrip()}, {_ST} SELECT k, CAST(before AS VARCHAR) AS start, CAST(ts AS VARCHAR) AS \"end\", step AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM st JOIN m USING (k) WHERE step > 1 * modal_step) WHERE r <= 10"
)
def l06(spark, d):
    return _d(S.gaps(series(spark, d), K, factor=1.0), "start", "end")


@query(
    "l07_constant_runs",
    f"{W.rstrip()}, c AS (SELECT k, pos, floor(value / 400000) AS value FROM s), f AS (SELECT *, sum(CASE WHEN value IS DISTINCT FROM l THEN 1 ELSE 0 END) OVER ({P}) AS run FROM (SELECT *, lag(value) OVER ({P}) AS l FROM c)) SELECT k, min(pos) AS start_pos, count(*) AS length, any_value(value) AS value FROM f GROUP BY k, run HAVING count(*) >= 5"
)
def l07(spark, d):
    return S.constant_runs(series(spark, d).withColumn("value", F.floor(F.col("value") / 400000).cast("double")), K)


@query(
    "l08_describe",
    f"{W}SELECT k, count(value) AS n, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, min(value) AS min, max(value) AS max, round(max(value) - min(value), 2) AS range, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 2) AS iqr, round(100 * stddev_samp(value) / avg(value), 4) AS cv_pct, round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis FROM s GROUP BY k"
)
def l08(spark, d):
    return _r(_r(S.describe(series(spark, d), K), 2, "mean", "std", "range", "iqr"), 4, "cv_pct", "skewness", "kurtosis")


_MOM = "g AS (SELECT k, count(*)::DOUBLE AS n, avg(power((value - m) / sd, 3)) AS g1, avg(power((value - m) / sd, 4)) - 3 AS g2 FROM (SELECT *, avg(value) OVER (PARTITION BY k) AS m, stddev_pop(value) OVER (PARTITION BY k) AS sd FROM s) GROUP BY k)"


@query(
    "l09_jarque_bera",
    f"{W.rstrip()}, {_MOM} SELECT k, CAST(n AS BIGINT) AS n, round(n / 6 * (g1 * g1 + g2 * g2 / 4), 4) AS jb, round(exp(-n / 12 * (g1 * g1 + g2 * g2 / 4)), 6) AS p FROM g"
)
def l09(spark, d):
    return _r(_r(S.jarque_bera(series(spark, d), K), 4, "jb"), 6, "p")


@query(
    "l10_dagostino",
    f"{W.rstrip()}, {_MOM}, a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta, (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM g), b2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM a), c AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (aa - 4)) AS dd FROM b2) SELECT k, CAST(n AS BIGINT) AS n, round(z1 * z1 + power((1 - 2 / (9 * aa) - sign(dd) * cbrt((1 - 2 / aa) / abs(dd))) / sqrt(2 / (9 * aa)), 2), 4) AS k2 FROM c"
)
def l10(spark, d):
    return _r(S.dagostino(series(spark, d), K), 4, "k2").drop("p")


@query("l11_shapiro")
def l11(spark, d):
    from tidewell.operators.tests_stat import shapiro_by

    return shapiro_by(series(spark, d), K, F.col("value"))


@query("l12_normality")
def l12(spark, d):
    return S.run_timeseries(
        t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("k"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value")),
        "ts", "value", K, ("normality",)
    )["normality"]


for _n, _f in {
    "l13_adf": S.adf, "l14_kpss": S.kpss, "l15_zivot_andrews": S.zivot_andrews, "l16_stationarity": S.stationarity,
    "l17_differencing": S.differencing, "l19_stl": lambda s, k: S.stl(s, k, 7), "l26_mean_shifts": S.mean_shifts,
    "l28_cusum_threshold": S.cusum_threshold, "l41_readiness": S.readiness
}.items():

    @query(_n)
    def _run(spark, d, f=_f):
        return f(series(spark, d), K)


_TR = "tr AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend FROM s WINDOW w AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), ph AS (SELECT k, pos % 7 AS phase, avg(value - trend) AS m FROM tr GROUP BY 1, 2), ce AS (SELECT k, avg(m) AS c FROM ph GROUP BY 1), de AS (SELECT tr.k, pos, value, trend, m - c AS seasonal, value - trend - (m - c) AS residual FROM tr JOIN ph ON tr.k = ph.k AND pos % 7 = phase JOIN ce ON tr.k = ce.k)"


@query("l18_decompose", f"{W.rstrip()}, {_TR} SELECT k, pos, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal, round(residual, 2) AS residual FROM de")
def l18(spark, d):
    return _r(S.decompose(series(spark, d), K, 7), 2, "trend", "seasonal", "residual").select("k", "pos", "trend", "seasonal", "residual")


@query(
    "l20_strengths",
    f"{W.rstrip()}, {_TR} SELECT k, round(least(greatest(100 * (1 - var_samp(residual) / var_samp(trend + residual)), 0), 100), 4) AS trend_strength, round(least(greatest(100 * (1 - var_samp(residual) / var_samp(seasonal + residual)), 0), 100), 4) AS seasonal_strength FROM de WHERE residual IS NOT NULL GROUP BY k"
)
def l20(spark, d):
    return _r(S.strengths(S.decompose(series(spark, d), K, 7), K), 4, "trend_strength", "seasonal_strength")


@query(
    "l39_seasonal_order",
    f"{W.rstrip()}, {_TR} SELECT k, CAST(100 * (1 - var_samp(residual) / var_samp(seasonal + residual)) >= 64 AS INTEGER) AS seasonal_d FROM de WHERE residual IS NOT NULL GROUP BY k"
)
def l39(spark, d):
    return S.seasonal_order(S.decompose(series(spark, d), K, 7), K)


@query(
    "l25_spectrum",
    f"{W.rstrip()}, n AS (SELECT k, count(*) AS n, avg(value) AS m FROM s GROUP BY k), f AS (SELECT k, n, m, unnest(range(1, n // 2 + 1)) AS j FROM n), p AS (SELECT f.k, n, j, sum((value - m) * cos(2 * pi() * ((j * pos) % n) / n)) AS re, sum((value - m) * sin(2 * pi() * ((j * pos) % n) / n)) AS im FROM f JOIN s ON s.k = f.k GROUP BY 1, 2, 3), r AS (SELECT k, n, j, re * re + im * im AS power, row_number() OVER (PARTITION BY k ORDER BY re * re + im * im DESC) AS rank FROM p) SELECT k, CAST(rank AS INTEGER) AS rank, round(n / j, 6) AS period, round(power / 1e9, 2) AS power FROM r WHERE rank <= 5"
)
def l25(spark, d):
    return _r(_r(S.spectrum(series(spark, d), K).withColumn("power", F.col("power") / 1e9), 6, "period"), 2, "power")


@query(
    "l21_default_period",
    f"{W}SELECT k, CAST(least(greatest(least(floor(count(*) / 10), 365), 2), floor(count(*) / 2)) AS INTEGER) AS period FROM s GROUP BY k"
)
def l21(spark, d):
    return S.default_period(series(spark, d), K)


_ACF = "st2 AS (SELECT k, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM s GROUP BY k), lg AS (SELECT unnest(range(61)) AS lag), ac AS (SELECT a.k, lag, n, sum((a.value - m) * (b.value - m)) / any_value(ss) AS acf FROM s a JOIN st2 ON a.k = st2.k JOIN lg ON lag <= least(60, greatest(10, floor(n / 3))) JOIN s b ON b.k = a.k AND b.pos = a.pos + lag GROUP BY 1, 2, 3)"


@query(
    "l22_autocorrelation",
    f"{W.rstrip()}, {_ACF} SELECT k, CAST(lag AS INTEGER) AS lag, n, round(acf, 6) AS acf, round(CASE WHEN lag > 0 THEN 1.96 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY k ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) ELSE 0 END, 6) AS bound FROM ac"
)
def l22(spark, d):
    return _r(S.autocorrelation(series(spark, d), K), 6, "acf", "bound")


@query("l23_partial_autocorrelation")
def l23(spark, d):
    return S.partial_autocorrelation(S.autocorrelation(series(spark, d), K), K)


@query(
    "l24_significant_lags",
    f"{W.rstrip()}, {_ACF} SELECT k, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS value FROM ac WHERE lag > 0 AND abs(acf) > 1.96 / sqrt(n)"
)
def l24(spark, d):
    return _r(S.significant_lags(S.autocorrelation(series(spark, d), K), K), 6, "value")


#: The series with every seventh value doubled.
_WK = f"{W.rstrip()}, s7 AS (SELECT k, pos, CASE WHEN pos % 7 = 0 THEN 2 * value ELSE value END AS value FROM s), "


@query(
    "l38_seasonal_period",
    f"{_WK}{_ACF.replace('FROM s ', 'FROM s7 ').replace('JOIN s b', 'JOIN s7 b')}, pk AS (SELECT *, lag(acf) OVER (PARTITION BY k ORDER BY lag) AS a, lead(acf) OVER (PARTITION BY k ORDER BY lag) AS b FROM ac) SELECT k, CAST(arg_max(lag, acf) AS INTEGER) AS period, round(max(acf), 6) AS strength FROM pk WHERE lag >= 2 AND acf > a AND acf > b AND acf > 0.2 GROUP BY k"
)
def l38(spark, d):
    weekly = series(spark, d).withColumn("value", F.when(F.col("pos") % 7 == 0, 2 * F.col("value")).otherwise(F.col("value")))
    return _r(S.seasonal_period(S.autocorrelation(weekly, K), K), 6, "strength")


_CU = f"cu AS (SELECT k, pos, CASE WHEN pos = 0 THEN 0 ELSE value - m - 1000 END AS u, CASE WHEN pos = 0 THEN 0 ELSE m - value - 1000 END AS dn FROM (SELECT *, avg(value) OVER (PARTITION BY k) AS m FROM s)), cc AS (SELECT k, pos, sum(u) OVER ({P}) AS cu, sum(dn) OVER ({P}) AS cd FROM cu), cs AS (SELECT k, pos, cu - min(cu) OVER ({P}) AS up, cd - min(cd) OVER ({P}) AS down FROM cc)"


@query("l27_cusum", f"{W.rstrip()}, {_CU} SELECT k, pos, round(up, 1) AS up, round(down, 1) AS down FROM cs")
def l27(spark, d):
    return _r(S.cusum(series(spark, d), K, 1000.0), 1, "up", "down").select("k", "pos", "up", "down")


@query(
    "l27_crossings",
    f"{W.rstrip()}, {_CU}, cr AS (SELECT *, CASE WHEN up > 1e6 AND coalesce(lag(up) OVER ({P}), 0) <= 1e6 THEN 'up' WHEN down > 1e6 AND coalesce(lag(down) OVER ({P}), 0) <= 1e6 THEN 'down' END AS side FROM cs) SELECT k, pos, side FROM (SELECT *, row_number() OVER ({P}) AS r FROM cr WHERE side IS NOT NULL) WHERE r <= 20"
)
def l27b(spark, d):
    return S.crossings(S.cusum(series(spark, d), K, 1000.0), K, 1e6)


@query(
    "l29_noise_scale",
    f"{W.rstrip()}, df AS (SELECT k, value - lag(value) OVER ({P}) AS d FROM s), md AS (SELECT k, quantile_cont(d, 0.5) AS m FROM df WHERE d IS NOT NULL GROUP BY k) SELECT k, round(quantile_cont(abs(d - m), 0.5) * 1.4826 / sqrt(2.0), 3) AS scale FROM df JOIN md USING (k) WHERE d IS NOT NULL GROUP BY k"
)
def l29(spark, d):
    return _r(S.noise_scale(series(spark, d), K), 3, "scale")


_N = "sn AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM s), sw AS (SELECT *, greatest(3, n // 20) AS w3, greatest(7, n // 10) AS w7, greatest(14, n // 5) AS w14, greatest(5, n // 15) AS w5 FROM sn)"
_AN = f"{_N}, an AS (SELECT *, (value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 1) + 1e-9) AS z FROM sw WINDOW w AS (PARTITION BY k ORDER BY pos ROWS BETWEEN w3 // 2 PRECEDING AND (w3 - 1) // 2 FOLLOWING)), q AS (SELECT k, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY k)"


@query("l30_rolling_anomalies", f"{W.rstrip()}, {_AN} SELECT k, pos, round(z, 4) AS z FROM an WHERE abs(z) > 3")
def l30(spark, d):
    return _r(S.anomalies(series(spark, d), K).filter("rolling"), 4, "z").select("k", "pos", "z")


@query(
    "l31_anomalies",
    f"{W.rstrip()}, {_AN} SELECT k, pos, abs(z) > 3 OR value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) AS anomaly FROM an JOIN q USING (k)"
)
def l31(spark, d):
    return S.anomalies(series(spark, d), K).select("k", "pos", "anomaly")


#: Means of amounts in cents are often exact halves; both engines round them aside.
_ASIDE = 0.00314159
_RW = ", ".join(
    f"round(avg(value) OVER {w} + {_ASIDE}, 2) AS mean_{w}, round(stddev_samp(value) OVER {w} + {_ASIDE}, 2) AS std_{w}" for w in ("short", "middle", "long")
)
_RF = ", ".join(f"{w} AS (PARTITION BY k ORDER BY pos ROWS BETWEEN {c} - 1 PRECEDING AND CURRENT ROW)" for w, c in (("short", "w3"), ("middle", "w7"), ("long", "w14")))


@query("l32_rolling", f"{W.rstrip()}, {_N} SELECT k, pos, {_RW} FROM sw WINDOW {_RF}")
def l32(spark, d):
    columns = [f"{c}_{w}" for w in S.SHARES for c in ("mean", "std")]
    return S.rolling(series(spark, d), K).withColumns({c: F.round(F.col(c) + _ASIDE, 2) for c in columns}).drop("ts", "value")


@query(
    "l33_ewma",
    f"{W.rstrip()}, al AS (SELECT *, 2.0 / (greatest(2, count(*) OVER (PARTITION BY k) // 10) + 1) AS al FROM s) SELECT k, pos, round(power(1 - al, pos) * sum(CASE WHEN pos = 0 THEN 1 ELSE al END * power(1 - al, -pos) * value) OVER (PARTITION BY k ORDER BY pos), 2) AS ewma FROM al"
)
def l33(spark, d):
    return _r(S.ewma(series(spark, d), K), 2, "ewma").select("k", "pos", "ewma")


@query(
    "l34_volatility",
    f"{W.rstrip()}, {_N}, r AS (SELECT *, CASE WHEN value / lag(value) OVER ({P}) > 0 THEN ln(value / lag(value) OVER ({P})) END AS r FROM sw) SELECT k, pos, round(CASE WHEN count(r) OVER w = w5 THEN stddev_samp(r) OVER w * sqrt(252) END, 4) AS volatility FROM r WINDOW w AS (PARTITION BY k ORDER BY pos ROWS BETWEEN w5 - 1 PRECEDING AND CURRENT ROW)"
)
def l34(spark, d):
    return _r(S.volatility(series(spark, d), K), 4, "volatility").select("k", "pos", "volatility")


_LAGS = "(SELECT k, unnest(range(1, 1 + CAST(least(20, count(*) // 5) AS BIGINT))) AS lag FROM s GROUP BY k) l"


@query(
    "l35_lag_correlations",
    f"{W}SELECT a.k, CAST(lag AS INTEGER) AS lag, round(corr(a.value, b.value), 6) AS pearson FROM s a JOIN {_LAGS} ON a.k = l.k JOIN s b ON a.k = b.k AND b.pos = a.pos + lag GROUP BY 1, 2"
)
def l35(spark, d):
    return _r(S.lag_correlations(series(spark, d), K), 6, "pearson")


@query(
    "l35_lag_rank_correlations",
    f"{W.rstrip()}, j AS (SELECT a.k, lag, a.value AS x, b.value AS y FROM s a JOIN {_LAGS} ON a.k = l.k JOIN s b ON a.k = b.k AND b.pos = a.pos + lag), r AS (SELECT k, lag, rank() OVER (PARTITION BY k, lag ORDER BY x) + (count(*) OVER (PARTITION BY k, lag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY k, lag ORDER BY y) + (count(*) OVER (PARTITION BY k, lag, y) - 1) / 2 AS ry FROM j) SELECT k, CAST(lag AS INTEGER) AS lag, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1, 2"
)
def l35b(spark, d):
    return _r(S.lag_rank_correlations(series(spark, d), K), 6, "spearman")


@query("l36_linear_trend", f"{W}SELECT k, count(*) AS n, round(regr_slope(value, pos), 4) AS slope, round(regr_r2(value, pos), 6) AS r2 FROM s GROUP BY k")
def l36(spark, d):
    return _r(_r(S.linear_trend(series(spark, d), K), 4, "slope"), 6, "r2").drop("p")


_TH = "n AS (SELECT k, count(*) AS n FROM s GROUP BY k), pk AS (SELECT k, n, unnest(range(least(n, 200))) AS j FROM n), th AS (SELECT s.k, s.value, j AS pos FROM pk JOIN s ON s.k = pk.k AND s.pos = CASE WHEN n <= 200 THEN j ELSE CAST(round_even(j * (n - 1) / 199, 0) AS BIGINT) END)"


@query("l43_thin", f"{W.rstrip()}, {_TH} SELECT k, pos, value FROM th")
def l43(spark, d):
    return S.thin(series(spark, d), K, 200).select("k", "pos", "value")


@query(
    "l37_mann_kendall",
    f"{W}SELECT a.k, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s, round(quantile_cont((b.value - a.value) / (b.pos - a.pos), 0.5), 4) AS slope FROM s a JOIN s b ON a.k = b.k AND a.pos < b.pos GROUP BY a.k"
)
def l37(spark, d):
    return _r(S.mann_kendall(series(spark, d), K), 4, "slope").select("k", F.col("s").cast("long").alias("s"), "slope")


@query("l40_granger")
def l40(spark, d):
    e = t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).pivot(
        "event_type", ["click", "view", "purchase"]
    ).count().fillna(0).withColumn("k", F.lit("all"))
    return S.granger(e, "ts", "purchase", ["click", "view"], K)


@query(
    "l42_method_groups",
    "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis FROM events GROUP BY 1"
)
def l42(spark, d):
    e = t(spark, d, "events").select("event_type", "ts", "value")
    out = S.run_timeseries(e, "ts", "value", ["event_type"], ("describe",))["describe"]
    return _r(out, 4, "mean", "std", "min", "max", "iqr", "skewness", "kurtosis").drop("range", "cv_pct")
