"""Time series, thousands at a time: every operator works per series key.

A prepared series has the key columns, ``ts``, ``pos`` (0-based position) and ``value``.
Windows are partitioned by the keys. Regressions, lag products and running averages go by
blocks of a series (``longseries``). Decompositions, spectra, mean shifts and Mann-Kendall run
in one task per series on all its points; a task holds the values of one series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import name
from tidewell.functions.dist import p_normal, p_t
from tidewell.operators import longseries
from tidewell.operators.profile import unbiased_kurtosis, unbiased_skewness
from tidewell.operators.ranks import exact_quantiles


def _by(keys: list[str], order: str = "pos") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def prepare(df: DataFrame, time: str, value: str, keys: list[str], tiebreak: list[str] | None = None, least: int = 10) -> DataFrame:
    """Parse times, sort, number the rows; series with fewer than ``least`` values are left out."""
    kind = df.schema[time].dataType.simpleString()
    ts = name(time) if kind in ("date", "timestamp", "timestamp_ntz") else F.try_to_timestamp(name(time).cast("string"))
    rows = df.select(
        *(name(k) for k in keys), ts.alias("ts"), name(value).cast("double").alias("value"),
        *(name(c).alias(f"__{i}") for i, c in enumerate(tiebreak or []))
    ).filter("ts IS NOT NULL")
    w = Window.partitionBy(*keys)
    order = w.orderBy("ts", *(f"__{i}" for i in range(len(tiebreak or []))), "value")
    return rows.withColumns({
        "pos": F.row_number().over(order) - 1, "__n": F.count("value").over(w)
    }).filter(F.col("__n") >= least).select(*keys, "ts", F.col("pos").cast("long").alias("pos"), "value")


def interpolate(s: DataFrame, keys: list[str]) -> DataFrame:
    """Linear by position; ends take the nearest value."""
    w = _by(keys)
    known = F.when(F.col("value").isNotNull(), F.struct("pos", "value"))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # from the end on: a frame that ends with the series would be gone through anew for every row
    b = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0))
    j = s.withColumns({"__a": a, "__b": b})
    step = F.try_divide(F.col("__b.value") - F.col("__a.value"), (F.col("__b.pos") - F.col("__a.pos")).cast("double"))
    mid = F.col("__a.value") + step * (F.col("pos") - F.col("__a.pos"))
    return j.withColumn("value", F.coalesce("value", mid, F.col("__a.value"), F.col("__b.value"))).drop("__a", "__b")


def seconds(c: Column | str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def steps(s: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``step``: seconds since the row before."""
    return s.withColumn("step", seconds("ts") - F.lag(seconds("ts")).over(_by(keys)))


def quality(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: rows, missing_pct, duplicate_times, zeros, modal_step, irregular_pct, frequency."""
    st = steps(s, keys)
    mode = st.filter("step IS NOT NULL").groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.max_by("step", F.struct("c", -F.col("step"))).alias("modal_step"))
    base = st.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"),
        (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicate_times"), F.count_if(F.col("value") == 0).alias("zeros")
    )
    odd = st.join(mode, keys).groupBy(*keys).agg((100.0 * F.try_divide(
        F.count_if(F.col("step") != F.col("modal_step")), F.count("step")
    )).alias("irregular_pct"))
    m = F.col("modal_step")
    label = F.when(m < 60, "s").when(m < 3600, "min").when(m < 86400, "h").when(m < 86400 * 6, "D").when(m < 86400 * 25, "W").otherwise("M")
    out = base.join(mode, keys).join(odd, keys)
    return out.select(
        *keys, "rows", (100.0 * F.col("missing") / F.col("rows")).alias("missing_pct"), "duplicate_times", "zeros", "modal_step", "irregular_pct",
        label.alias("frequency")
    )


def gaps(s: DataFrame, keys: list[str], factor: float = 2.0, first: int = 10) -> DataFrame:
    """Rows (start, end, seconds): steps above ``factor`` times the modal one, the first of each series."""
    st = steps(s, keys).withColumn("start", F.lag("ts").over(_by(keys)))
    found = st.join(quality(s, keys).select(*keys, "modal_step"), keys).filter(F.col("step") > factor * F.col("modal_step"))
    found = found.withColumn("__n", F.row_number().over(_by(keys))).filter(F.col("__n") <= first)
    return found.select(*keys, "start", F.col("ts").alias("end"), F.col("step").alias("seconds"))


def constant_runs(s: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Rows (start_pos, length, value) of equal neighbours."""
    w = _by(keys)
    change = (~F.col("value").eqNullSafe(F.lag("value").over(w))).cast("int")
    runs = s.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w)).groupBy(*keys, "__run").agg(
        F.min("pos").alias("start_pos"), F.count(F.lit(1)).alias("length"), F.first("value").alias("value")
    )
    return runs.filter(F.col("value").isNotNull() & (F.col("length") >= least)).drop("__run")


def describe(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: n, mean, std, min, max, range, iqr, cv_pct, skewness, kurtosis."""
    q = F.col("q")
    out = s.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"),
        (100 * F.try_divide(F.stddev_samp("value"), F.avg("value"))).alias("cv_pct"), unbiased_skewness(F.col("value")).alias("skewness"),
        unbiased_kurtosis(F.col("value")).alias("kurtosis")
    )
    return out.join(exact_quantiles(s, keys, F.col("value"), [0.25, 0.75]), keys, "left").withColumn("iqr", q[1] - q[0]).drop("q")


def jarque_bera(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: n, jb, p."""
    g = s.groupBy(*keys).agg(F.count("value").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    jb = F.col("n") / 6.0 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)
    return g.select(*keys, "n", jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def dagostino(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series with 8 values or more: n, k2, p."""
    g = s.groupBy(*keys).agg(
        F.count("value").cast("double").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")
    ).filter("n >= 8 AND g1 IS NOT NULL")
    e = F.expr
    g = g.withColumn("y", e("g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))")).withColumn(
        "beta", e("3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))")
    )
    g = g.withColumn("w2", e("sqrt(2 * (beta - 1)) - 1")).withColumn("z1", e("asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2))"))
    g = g.withColumn("x", e("(g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))"))
    g = g.withColumn(
        "s", e("6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))")
    ).withColumn("a", e("6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s)))"))
    g = g.withColumn("d", e("1 + x * sqrt(2 / (a - 4))")).withColumn("z2", e("(1 - 2 / (9 * a) - signum(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a))"))
    return g.select(*keys, F.col("n").cast("long").alias("n"), e("z1 * z1 + z2 * z2").alias("k2")).withColumn("p", F.exp(-F.col("k2") / 2))


# --- thinning and per-series numpy ------------------------------------------------------------


def thin(s: DataFrame, keys: list[str], points: int) -> DataFrame:
    """At most ``points`` evenly spaced rows of each series, ends included, renumbered."""
    n = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    k = n.withColumn("__k", F.explode(F.sequence(F.lit(0), F.least(F.col("__n"), F.lit(points)).cast("int") - 1)))
    at = F.when(F.col("__n") <= points, F.col("__k")).otherwise(F.bround(F.col("__k") * (F.col("__n") - 1) / (points - 1))).cast("long")
    return s.join(k.select(*keys, at.alias("pos"), F.col("__k").cast("long").alias("__new")), [*keys, "pos"]).withColumn("pos", F.col("__new")).drop("__new")


def per_series(s: DataFrame, keys: list[str], f, schema: str, at: str | None = None) -> DataFrame:
    """Apply f(values) -> list of result rows to each series without nulls.

    The result column ``at`` counts the values f was given; it is turned into positions of the series.
    """
    fields = [x.strip().split()[0] for x in schema.split(",")]
    known = s.filter("value IS NOT NULL").select(*keys, "pos", "value")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = pd.DataFrame([(*key, *row) for row in f(pdf["value"].to_numpy(float))], columns=[*keys, *fields])
        if at and len(out):
            out[at] = pdf["pos"].to_numpy()[out[at].to_numpy(int)]
        return out

    kinds = ", ".join(f"`{k}` {s.schema[k].dataType.simpleString()}" for k in keys)
    return known.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def _blocks(first: int, end: int, width: int) -> list[tuple[int, int]]:
    """Bounds of row blocks with about 4 million cells."""
    rows = max(1024, 4_000_000 // width)
    return [(a, min(a + rows, end)) for a in range(first, end, rows)]


def adf(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: unit-root test with constant, lags by AIC; p from a response surface."""
    return longseries.adf(s, keys)


def kpss(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: level stationarity; p between 0.01 and 0.10."""
    return longseries.kpss(s, keys)


def zivot_andrews(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: unit root against one break in level; the break with the smallest t."""
    return longseries.zivot_andrews(s, keys)


def stationarity(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: adf_p, kpss_p and the verdict of both."""
    j = adf(s, keys).select(*keys, F.col("p").alias("adf_p")).join(kpss(s, keys).select(*keys, F.col("p").alias("kpss_p")), keys, "full")
    a, k = F.col("adf_p") < 0.05, F.col("kpss_p") > 0.05
    return j.withColumn("verdict", F.when(a & k, "stationary").when(~a & ~k, "non_stationary").when(a.isNull() | k.isNull(), "unknown").otherwise("mixed"))


def difference(s: DataFrame, keys: list[str], lag: int = 1) -> DataFrame:
    """The series of differences at ``lag``."""
    out = s.withColumn("value", F.col("value") - F.lag("value", lag).over(_by(keys))).filter("value IS NOT NULL")
    return out.withColumn("pos", (F.row_number().over(_by(keys)) - 1).cast("long"))


def differencing(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: how often to difference (0 to 2) until the unit root is rejected."""
    p0, p1 = (adf(x, keys).select(*keys, F.col("p").alias(n)) for x, n in ((s, "p0"), (difference(s, keys), "p1")))
    return p0.join(p1, keys, "left").select(*keys, F.when(F.col("p0") < 0.05, 0).when(F.col("p1") < 0.05, 1).otherwise(2).alias("d"))


# --- decomposition and autocorrelation ------------------------------------------------------------


def default_period(s: DataFrame, keys: list[str], found: DataFrame | None = None) -> DataFrame:
    """Per series: the detected period, else a tenth of the length in 2..365, at most half of it."""
    n = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if found is not None:
        n = n.join(found.select(*keys, "period"), keys, "left")
    guess = F.greatest(F.least(F.floor(F.col("n") / 10), F.lit(365)), F.lit(2))
    chosen = F.coalesce(F.col("period"), guess) if found is not None else guess
    return n.select(*keys, F.least(chosen, F.floor(F.col("n") / 2)).cast("int").alias("period"))


def decompose(s: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Rows with trend (centred moving average), seasonal (period means, centred) and residual."""
    w, half = _by(keys), period // 2
    if period % 2:
        trend, full = F.avg("value").over(w.rowsBetween(-half, half)), F.count("value").over(w.rowsBetween(-half, half)) == period
    else:
        inner = F.sum("value").over(w.rowsBetween(-half + 1, half - 1))
        trend = (inner + 0.5 * (F.lag("value", half).over(w) + F.lead("value", half).over(w))) / period
        full = trend.isNotNull()
    t = s.withColumn("trend", F.when(full, trend))
    part = Window.partitionBy(*keys, "__phase")
    t = t.withColumn("__phase", F.pmod("pos", F.lit(period))).withColumn("__m", F.avg(F.col("value") - F.col("trend")).over(part))
    centre = t.groupBy(*keys, "__phase").agg(F.first("__m").alias("m")).groupBy(*keys).agg(F.avg("m").alias("__c"))
    out = t.join(centre, keys).withColumn("seasonal", F.col("__m") - F.col("__c"))
    return out.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")).drop("__phase", "__m", "__c")


def strengths(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: trend and seasonal strength in percent of what is not residual."""
    complete = parts.filter("residual IS NOT NULL")
    g = complete.groupBy(*keys).agg(
        F.var_samp("residual").alias("r"), F.var_samp(F.col("trend") + F.col("residual")).alias("t"),
        F.var_samp(F.col("seasonal") + F.col("residual")).alias("s")
    )
    pct = lambda v: F.least(F.greatest(100 * (1 - F.try_divide(F.col("r"), F.col(v))), F.lit(0.0)), F.lit(100.0))
    return g.select(*keys, pct("t").alias("trend_strength"), pct("s").alias("seasonal_strength"))


def _loess(y: np.ndarray, span: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local linear smoothing with tricube weights at every position."""
    n = len(y)
    q = min(max(3, span), n)
    out = np.empty(n)
    for a, b in _blocks(0, n, q):
        at = np.arange(a, b)
        start = np.clip(at - q // 2, 0, n - q)
        idx = start[:, None] + np.arange(q)[None, :]
        d = np.abs(idx - at[:, None])
        w = (1 - np.minimum(d / np.maximum(d.max(axis=1, keepdims=True), 1) * 0.999, 1) ** 3) ** 3
        if weights is not None:
            w = w * weights[idx]
        x, v = idx - at[:, None], y[idx]
        sw, sx, sxx, sy, sxy = w.sum(1), (w * x).sum(1), (w * x * x).sum(1), (w * v).sum(1), (w * x * v).sum(1)
        det = sw * sxx - sx * sx
        out[a:b] = np.where(np.abs(det) > 1e-12, (sxx * sy - sx * sxy) / np.where(det == 0, 1, det), sy / np.maximum(sw, 1e-12))
    return out


def stl(s: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Rows (pos, value, trend, seasonal, residual) by LOESS seasonal decomposition, per series; nulls are left out, so interpolate first."""

    def run(x: np.ndarray) -> list[tuple]:
        n, trend, seasonal = len(x), np.zeros(len(x)), np.zeros(len(x))
        for _ in range(2):
            d, cycle = x - trend, np.zeros(n)
            for k in range(min(period, n)):
                cycle[k::period] = _loess(d[k::period], 7)
            low = cycle.copy()
            for width in (period, period, 3):
                pad = np.pad(low, (width // 2, width - 1 - width // 2), mode="edge")
                low = np.convolve(pad, np.ones(width) / width, mode="valid")
            seasonal = cycle - _loess(low, period | 1)
            trend = _loess(x - seasonal, int(1.5 * period) | 1)
        return list(zip(range(n), x, trend, seasonal, x - trend - seasonal))

    return per_series(s, keys, run, "pos long, value double, trend double, seasonal double, residual double", at="pos")


def max_lag(n: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(10), F.floor(n / 3))).cast("int")


def autocorrelation(s: DataFrame, keys: list[str], size: int = longseries.SIZE) -> DataFrame:
    """Rows (lag, acf, bound): lags 0..min(60, max(10, n/3)) with Bartlett's bound."""
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("ss"))
    x = s.join(g, keys).select(*keys, "pos", (F.col("value") - F.col("m")).alias("e"), "n")
    c = longseries.lag_products(x, keys, F.least(max_lag(F.col("n")).cast("long"), F.col("n") - 1), 60, size).join(g, keys)
    r = c.select(*keys, "lag", "n", F.try_divide("c", "ss").alias("acf"))
    before = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2)).over(_by(keys, "lag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return r.select(*keys, "lag", "n", "acf", F.when(F.col("lag") > 0, 1.96 * F.sqrt((1 + 2 * before) / F.col("n"))).otherwise(0.0).alias("bound"))


def partial_autocorrelation(acf: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (lag, n, pacf) by Levinson and Durbin's recursion on the at most 61 rows of a series."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy(float)
        phi, out, v = np.zeros(0), [1.0], 1.0
        for k in range(1, len(r)):
            a = (r[k] - phi @ r[k - 1 : 0 : -1][: len(phi)]) / v if v > 1e-12 else 0.0
            phi = np.append(phi - a * phi[::-1], a)
            v *= 1 - a * a
            out.append(float(a))
        return pd.DataFrame([(*key, i, int(pdf["n"].iloc[0]), p) for i, p in enumerate(out)], columns=[*keys, "lag", "n", "pacf"])

    kinds = ", ".join(f"`{k}` {acf.schema[k].dataType.simpleString()}" for k in keys)
    return acf.groupBy(*keys).applyInPandas(run, f"{kinds}, lag int, n long, pacf double")


def significant_lags(acf: DataFrame, keys: list[str], column: str = "acf") -> DataFrame:
    """Rows (lag, value) beyond 1.96 / sqrt(n)."""
    return acf.filter((F.col("lag") > 0) & (F.abs(column) > 1.96 / F.sqrt("n"))).select(*keys, "lag", F.col(column).alias("value"))


def seasonal_period(acf: DataFrame, keys: list[str], least: float = 0.2) -> DataFrame:
    """Per series the strongest local peak of the ACF at lag 2 or more: period, strength."""
    w = _by(keys, "lag")
    peaks = acf.withColumns({
        "a": F.lag("acf").over(w), "b": F.lead("acf").over(w)
    }).filter((F.col("lag") >= 2) & (F.col("acf") > F.col("a")) & (F.col("acf") > F.col("b")) & (F.col("acf") > least))
    return peaks.groupBy(*keys).agg(F.max_by("lag", F.struct("acf", -F.col("lag"))).alias("period"), F.max("acf").alias("strength"))


def seasonal_order(parts: DataFrame, keys: list[str], least: float = 64.0) -> DataFrame:
    """Per series: seasonal differencing order 0 or 1, by the seasonal strength."""
    return strengths(parts, keys).select(*keys, (F.col("seasonal_strength") >= least).cast("int").alias("seasonal_d"))


def spectrum(s: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Rows (rank, period, power) of the strongest frequencies; period in positions."""

    def run(x: np.ndarray) -> list[tuple]:
        p = np.abs(np.fft.rfft(x - x.mean())) ** 2
        p[0] = -1
        order = np.argsort(-p, kind="stable")[:top]
        return [(r + 1, len(x) / int(k), float(p[k])) for r, k in enumerate(order) if p[k] > 0]

    return per_series(s, keys, run, "rank int, period double, power double")


# --- change points and anomalies -------------------------------------------------------------------


def _shifts(x: np.ndarray, least: int, penalty: float) -> list[int]:
    """Ends of the segments of the cheapest partition: squared error plus a penalty each, ``least`` points at least.

    A candidate for the last change is dropped once no level of the segment after it would
    make it the cheapest; as later points add the same to all candidates, it stays so. A
    candidate joins ``least`` points late, so the length rule is kept exactly.
    """
    n = len(x)
    y = x - x.mean()
    s1, s2 = np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    # pieces of the level's range with the candidate that is cheapest there: a + b m + c m^2, the same at all times
    low, high = np.array([y.min()]), np.array([y.max()])
    who = np.array([0])
    a, b, c = np.array([best[0]]), np.zeros(1), np.zeros(1)
    for t in range(least, n + 1):
        new = t - least
        if new >= least and np.isfinite(best[new]):
            da, db, dc = best[new] - s2[new] - a, 2 * s1[new] - b, -float(new) - c
            root = db * db - 4 * da * dc
            real = root > 0
            root = np.sqrt(np.where(real, root, 0.0))
            # dc < 0: the old one stays between the roots
            lo, hi = np.maximum(low, (-db + root) / (2 * dc)), np.minimum(high, (-db - root) / (2 * dc))
            keep = real & (lo < hi)
            lo, hi = lo[keep], hi[keep]
            begins, ends = np.append(y.min(), hi), np.append(lo, y.max())
            gap = begins < ends
            if gap.any():
                m = int(gap.sum())
                low, high = np.concatenate([lo, begins[gap]]), np.concatenate([hi, ends[gap]])
                who = np.concatenate([who[keep], np.full(m, new)])
                a = np.concatenate([a[keep], np.full(m, best[new] - s2[new])])
                b = np.concatenate([b[keep], np.full(m, 2 * s1[new])])
                c = np.concatenate([c[keep], np.full(m, -float(new))])
                order = np.argsort(low, kind="stable")
                low, high, who, a, b, c = low[order], high[order], who[order], a[order], b[order], c[order]
        d = s1[t] - s1[who]
        v = best[who] + s2[t] - s2[who] - d * d / (t - who)
        at = int(v.argmin())
        best[t], back[t] = v[at] + penalty, who[at]
    cuts, j = [], n
    while j > 0:
        cuts.append(j)
        j = int(back[j])
    return cuts[::-1]


def mean_shifts(s: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (pos, mean_before, mean_after): optimal partition by squared error, penalty var * ln n a shift.

    Segments have a twentieth of the points at least.
    """

    def run(x: np.ndarray) -> list[tuple]:
        n = len(x)
        least = max(2, n // 20)
        if n < least or np.ptp(x) == 0:
            return []
        edges = [0, *_shifts(x, least, float(x.var() * np.log(max(n, 2))))]
        return [(int(b), float(x[a:b].mean()), float(x[b:e].mean())) for a, b, e in zip(edges, edges[1:], edges[2:])]

    return per_series(s, keys, run, "pos long, mean_before double, mean_after double", at="pos")


def noise_scale(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: robust deviation from the spread of differences."""
    d = s.withColumn("d", F.col("value") - F.lag("value").over(_by(keys))).filter("d IS NOT NULL")
    m = exact_quantiles(d, keys, F.col("d"), [0.5], "m")
    spread = exact_quantiles(d.join(m, keys), keys, F.abs(F.col("d") - F.col("m")[0]), [0.5])
    return spread.select(*keys, (F.col("q")[0] * 1.4826 / F.sqrt(F.lit(2.0))).alias("scale"))


def cusum(s: DataFrame, keys: list[str], slack: DataFrame | float = 0.0) -> DataFrame:
    """Rows with ``up`` and ``down``: cumulated deviations beyond the slack, never below zero."""
    return longseries.cusum(s, keys, slack)


def crossings(c: DataFrame, keys: list[str], threshold: DataFrame | float, first: int = 20) -> DataFrame:
    """Rows (pos, side): where up or down first rises above the threshold, at most ``first`` per series."""
    t = F.lit(float(threshold)) if not isinstance(threshold, DataFrame) else F.col("threshold")
    x = c.join(threshold, keys) if isinstance(threshold, DataFrame) else c
    w = _by(keys)
    rise = lambda v: (F.col(v) > t) & (F.coalesce(F.lag(v).over(w), F.lit(0.0)) <= t)
    x = x.withColumn("side", F.when(rise("up"), "up").when(rise("down"), "down")).filter("side IS NOT NULL")
    return x.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= first).select(*keys, "pos", "side")


def cusum_threshold(s: DataFrame, keys: list[str], shuffles: int = 100, alpha: float = 0.05, slack: float = 0.0) -> DataFrame:
    """Per series: the quantile of the largest CUSUM over shuffled copies."""

    def run(x: np.ndarray) -> list[tuple]:
        rng = np.random.default_rng(42)
        top = []
        for _ in range(shuffles):
            d = rng.permutation(x) - x.mean()
            for sign in (1, -1):
                c = np.cumsum(np.concatenate(([0.0], (sign * d - slack)[1:])))
                top.append((c - np.minimum.accumulate(c)).max())
        return [(float(np.quantile(np.maximum(top[::2], top[1::2]), 1 - alpha)),)]

    return per_series(s, keys, run, "threshold double")


def anomalies(s: DataFrame, keys: list[str], window: int | None = None, z: float = 3.0) -> DataFrame:
    """Rows with z, rolling flag, fence flag (3 IQR) and their union; the window is centred, a twentieth of the rows (3 at least) if not given."""
    n = F.greatest(F.lit(3), F.floor(F.col("n") / 20)) if window is None else F.lit(window)
    x = longseries.windowed(s, keys, {"w": (F.floor(n / 2), F.floor((n - 1) / 2))})
    x = x.join(exact_quantiles(s, keys, F.col("value"), [0.25, 0.75]), keys)
    score = (F.col("value") - F.col("mean_w")) / (F.coalesce("std_w", F.lit(1.0)) + 1e-9)
    lo, hi = F.col("q")[0], F.col("q")[1]
    fence = (F.col("value") < lo - 3 * (hi - lo)) | (F.col("value") > hi + 3 * (hi - lo))
    out = x.withColumn("z", score).withColumns({"rolling": F.abs("z") > z, "fence": fence}).withColumn("anomaly", F.col("rolling") | F.col("fence"))
    return out.drop("q", "n", "mean_w", "std_w", "n_w")


#: Shares of a series' rows that rolling windows take, with the least lengths.
SHARES = {"short": (20, 3), "middle": (10, 7), "long": (5, 14)}


def rolling(s: DataFrame, keys: list[str], windows: list[int] | None = None) -> DataFrame:
    """Rows with mean_w and std_w over the last w values, for each window; ``short``, ``middle`` and ``long`` if none is given."""
    if windows is None:
        frames = {k: (F.greatest(F.lit(least), F.floor(F.col("n") / share)) - 1, F.lit(0)) for k, (share, least) in SHARES.items()}
    else:
        frames = {str(w): (F.lit(w - 1), F.lit(0)) for w in windows}
    return longseries.windowed(s, keys, frames).drop("n", *(f"n_{k}" for k in frames))


def ewma(s: DataFrame, keys: list[str], span: int | None = None) -> DataFrame:
    """Rows with ``ewma``: alpha = 2 / (span + 1); the span is a tenth of the series' rows if none is given."""
    return longseries.ewma(s, keys, span)


def volatility(s: DataFrame, keys: list[str], window: int | None = None) -> DataFrame:
    """Rows with ``volatility``: deviation of log returns times sqrt(252), full windows only, a fifteenth of the rows (5 at least) if not given."""
    ratio = F.try_divide(F.col("value"), F.lag("value").over(_by(keys)))
    r = s.withColumns({"__value": F.col("value"), "value": F.when(ratio > 0, F.log(ratio))})
    w = F.greatest(F.lit(5), F.floor(F.col("n") / 15)) if window is None else F.lit(window)
    x = longseries.windowed(r, keys, {"w": (w - 1, F.lit(0))}).withColumn("volatility", F.when(F.col("n_w") == w, F.col("std_w") * np.sqrt(252.0)))
    return x.withColumn("value", F.col("__value")).select(*s.columns, "volatility")


def _lags(n: Column, lags: int | None) -> Column:
    return F.least(F.lit(20), F.floor(n / 5)) if lags is None else F.lit(lags)


def lag_correlations(s: DataFrame, keys: list[str], lags: int | None = None, size: int = longseries.SIZE) -> DataFrame:
    """Rows (lag, pearson): correlation of a series with itself ``lag`` positions earlier, lags 1..min(20, n/5) if not given."""
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    x = s.join(g, keys).select(*keys, "pos", "value", "n")
    both = lambda pdf, lag: (pdf["value"].to_numpy(float), pdf["value"].to_numpy(float))
    return longseries.paired(x, keys, _lags(F.col("n"), lags), lags or 20, both, size).withColumnRenamed("r", "pearson")


def lag_rank_correlations(s: DataFrame, keys: list[str], lags: int | None = None, size: int = longseries.SIZE) -> DataFrame:
    """Rows (lag, spearman), ranks taken within each lag's pairs; nulls are left out beforehand.

    Values are ranked once: among the pairs of lag ``k`` all but the last (or first) ``k`` values stand,
    so a rank there is that among all less the few left-out values below it.
    """
    most = lags or 20
    x = longseries.numbered(s, keys)
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    x = x.join(g, keys)
    ends = x.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("i") < most, F.struct("i", "value")))), lambda v: v["value"]).alias("head"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("i") >= F.col("n") - most, F.struct("i", "value")))), lambda v: v["value"]).alias("tail")
    )
    v = Window.partitionBy(*keys).orderBy("value")
    ranked = x.withColumns({"below": (F.rank().over(v) - 1).cast("double"), "same": F.count(F.lit(1)).over(Window.partitionBy(*keys, "value")).cast("double")})
    ranked = ranked.join(ends, keys).select(*keys, F.col("i").alias("pos"), "value", "below", "same", "head", "tail", "n")

    def ranks(pdf: pd.DataFrame, lag: int) -> tuple[np.ndarray, np.ndarray]:
        value, out = pdf["value"].to_numpy(float), []
        for gone in (np.sort(pdf["head"].iloc[0][:lag]), np.sort(pdf["tail"].iloc[0][-lag:])):
            left, right = np.searchsorted(gone, value, "left"), np.searchsorted(gone, value, "right")
            out.append(pdf["below"].to_numpy() - left + (pdf["same"].to_numpy() - (right - left) + 1) / 2)
        return out[0], out[1]

    return longseries.paired(ranked, keys, _lags(F.col("n"), lags), most, ranks, size).withColumnRenamed("r", "spearman")


def linear_trend(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: slope per position, r2, p."""
    x, y = F.col("pos").cast("double"), F.col("value")
    g = s.filter("value IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")
    )
    r = F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy")))
    out = g.select(*keys, "n", F.try_divide("c", "vx").alias("slope"), r.alias("r"))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2)))
    return out.withColumn("r2", F.col("r") ** 2).withColumn("p", p_t(t, F.col("n") - 2)).drop("r")


def inversions(key: np.ndarray) -> int:
    """Pairs i < j with key[j] < key[i], bit by bit of the ranks: of those that agree so far, ones before zeros."""
    _, rank = np.unique(key, return_inverse=True)
    bits, total = int(rank.max(initial=0)).bit_length(), 0
    for bit in reversed(range(bits)):
        high = (rank >> bit) & 1
        group = rank >> (bit + 1)
        ones = np.cumsum(high) - high
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.repeat(ones[starts], np.diff(np.append(starts, len(rank))))
        total += int(((ones - before) * (1 - high)).sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]  # groups stay together, zeros first
    return total


#: Pairs whose slopes are looked at one by one.
MOST_PAIRS = 4_000_000


def _slopes_between(x: np.ndarray, v: np.ndarray, low: float, high: float) -> np.ndarray:
    """The slopes of the pairs that change their order between ``v - low x`` and ``v - high x``."""
    order = np.lexsort((x, v - low * x))
    x, v = x[order], v[order]
    after = np.lexsort((x, v - high * x))
    place = np.empty(len(x), np.int64)
    place[after] = np.arange(len(x))
    out, width = [], 1
    # merge runs of places: each crossing of two runs is one pair
    runs = place.copy()
    index = np.arange(len(x))
    while width < len(x):
        group = np.arange(len(x)) // (2 * width)
        right = (np.arange(len(x)) // width) & 1
        # within a group: right elements smaller than left ones
        base = group * np.int64(len(x) + 1)
        left_keys = (base + runs)[right == 0]
        r = np.flatnonzero(right == 1)
        if len(r):
            at = np.searchsorted(left_keys, (base + runs)[r], "right")
            end = np.searchsorted(left_keys, (group[r] + 1) * np.int64(len(x) + 1), "left")
            many = end - at
            j = np.repeat(index[r], many)
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i = index[right == 0][np.repeat(at, many) + offset]
            out.append((v[j] - v[i]) / (x[j] - x[i]))
        sort = np.argsort(base + runs, kind="stable")
        runs, index = runs[sort], index[sort]
        width *= 2
    return np.concatenate(out) if out else np.zeros(0)


def sen_slope(x: np.ndarray, v: np.ndarray) -> float:
    """The median of (v_j - v_i) / (x_j - x_i) over all pairs, ``x`` ascending, without making all pairs.

    Slopes below ``m`` are the pairs that ``v - m x`` has in the other order, so they are
    counted as inversions. Drawn pairs bracket the median; the bracket narrows by where the
    counts put it until few pairs are left in it, which are then made.
    """
    n = len(x)
    pairs = n * (n - 1) // 2
    wanted = [(pairs - 1) // 2, pairs // 2]
    below = lambda m: inversions(v - m * x)
    if pairs <= MOST_PAIRS:
        i, j = np.triu_indices(n, 1)
        return float(np.median((v[j] - v[i]) / (x[j] - x[i])))
    rng = np.random.default_rng(7)
    i, j = rng.integers(0, n, 200_000), rng.integers(0, n, 200_000)
    drawn = np.sort(((v[j] - v[i])[i != j]) / (x[j] - x[i])[i != j])
    share = 0.01
    while True:
        low, high = np.quantile(drawn, [max(0.0, 0.5 - share), min(1.0, 0.5 + share)])
        low, high = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)
        a, b = below(low), below(high)
        if a <= wanted[0] and wanted[1] < b:
            break
        share *= 3
        if share > 0.5:
            low, high = drawn[0] - np.ptp(v) - 1, drawn[-1] + np.ptp(v) + 1
            a, b = below(low), below(high)
            break
    while b - a > MOST_PAIRS and high - low > 1e-13 * max(abs(low), abs(high), 1e-300):
        width = high - low
        guess = low + width * (wanted[0] - a + 0.5) / (b - a)
        moved = False
        for cut in (guess - 0.02 * width, guess + 0.02 * width, low + 0.5 * width):
            if not low < cut < high:
                continue
            c = below(cut)
            if c <= wanted[0]:
                low, a, moved = cut, c, True
            elif c > wanted[1]:
                high, b, moved = cut, c, True
        if not moved:
            break
    if b - a > MOST_PAIRS:  # a great many pairs of the very same slope
        return float((low + high) / 2) if low * high > 0 else 0.0
    found = np.sort(_slopes_between(x, v, low, high))
    at = [min(max(w - a, 0), len(found) - 1) for w in wanted]
    return float((found[at[0]] + found[at[1]]) / 2)


def mann_kendall(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series, over all pairs of points: s, z, p, Sen's slope per position."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v, x = pdf["value"].to_numpy(float), pdf["pos"].to_numpy(float)
        n = len(v)
        t = np.unique(v, return_counts=True)[1].astype(float)
        up = n * (n - 1) // 2 - int((t * (t - 1) / 2).sum()) - 2 * inversions(v)
        sd = np.sqrt((n * (n - 1.0) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum()) / 18)
        z = 0.0 if up == 0 or sd == 0 else (up - np.sign(up)) / sd
        slope = sen_slope(x, v) if n > 1 else None
        return pd.DataFrame([(*key, float(up), float(z), slope)], columns=[*keys, "s", "z", "slope"])

    kinds = ", ".join(f"`{k}` {s.schema[k].dataType.simpleString()}" for k in keys)
    found = s.filter("value IS NOT NULL").select(*keys, "pos", "value").groupBy(*keys).applyInPandas(run, f"{kinds}, s double, z double, slope double")
    return found.withColumn("p", p_normal(F.col("z")))


def granger(df: DataFrame, time: str, target: str, others: list[str], keys: list[str]) -> DataFrame:
    """Rows (other, lags, chi2, p): does the past of ``other`` help to predict ``target``?"""
    rows = df.select(*keys, name(time).alias("ts"), name(target).cast("double").alias("value"), *(name(o).cast("double").alias(o) for o in others[:5])).dropna()
    rows = rows.withColumn("pos", (F.row_number().over(_by(keys, "ts")) - 1).cast("long"))
    return longseries.granger(rows, keys, others[:5])


def readiness(s: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: issues, suggested models and an ARIMA order, from the tables above."""
    acf = autocorrelation(s, keys)
    d = differencing(s, keys)
    pacf = significant_lags(partial_autocorrelation(acf, keys), keys, "pacf").groupBy(*keys).agg(F.min("lag").alias("ar"))
    ma = significant_lags(acf, keys).groupBy(*keys).agg(F.min("lag").alias("ma"))
    q = quality(s, keys)
    j = q.join(d, keys, "left").join(seasonal_period(acf, keys), keys, "left").join(pacf, keys, "left").join(ma, keys, "left")
    issues = F.concat_ws(
        ",", F.when(F.col("rows") < 50, "short"), F.when(F.col("missing_pct") > 5, "missing"), F.when(F.col("irregular_pct") > 10, "irregular"),
        F.when(F.col("d") > 0, "non_stationary")
    )
    models = F.concat_ws(
        ",", F.lit("arima"), F.when(F.col("period").isNotNull(), "seasonal_arima"), F.when(F.col("period").isNotNull(), "holt_winters"),
        F.when(F.col("rows") < 50, "naive")
    )
    order = F.concat_ws(
        ",", F.least(F.coalesce("ar", F.lit(0)), F.lit(3)).cast("string"), F.coalesce("d", F.lit(0)).cast("string"),
        F.least(F.coalesce("ma", F.lit(0)), F.lit(3)).cast("string")
    )
    return j.select(*keys, issues.alias("issues"), models.alias("models"), order.alias("arima_order"))


def _normality(s: DataFrame, keys: list[str]) -> DataFrame:
    from tidewell.operators.tests_stat import normality

    return normality(s, keys)


GROUPS = {
    "quality": quality, "describe": describe, "normality": _normality, "stationarity": stationarity, "autocorrelation": autocorrelation,
    "spectrum": spectrum, "change_points": mean_shifts, "trend": linear_trend, "readiness": readiness
}


def run_timeseries(df: DataFrame, time: str, value: str, keys: list[str], methods: tuple[str, ...] = ("quality", "describe")) -> dict[str, DataFrame]:
    """Only the groups asked for, lazily."""
    s = interpolate(prepare(df, time, value, keys), keys)
    return {m: GROUPS[m](s, keys) for m in methods}
