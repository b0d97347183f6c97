"""Queries return the whole job: no rows left out, no points thinned away."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import series
from tidewell.plans import catalog
from tidewell.plans.fixtures import t

from conftest import DATA


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_series_without_a_twin_take_all_orders(spark):
    want = {(r.k, r.ts): r.value for r in t(spark, str(DATA), "orders").groupBy(
        F.col("o_orderstatus").alias("k"), F.to_date("o_orderdate").alias("ts")
    ).agg(F.sum("o_totalprice").alias("value")).collect()}
    got = catalog.queries()["l19_stl"](spark, str(DATA)).groupBy("k").agg(F.count("*").alias("n"), F.sum("value").alias("value")).collect()
    assert {r.k: r.n for r in got} == {k: sum(x == k for x, _ in want) for k, _ in want}
    assert sum(r.value for r in got) == pytest.approx(float(sum(want.values())), abs=0.01 * len(want))
    lags = catalog.queries()["l23_partial_autocorrelation"](spark, str(DATA)).filter("lag = 0").collect()
    assert {r.k: r.n for r in lags} == {r.k: r.n for r in got}


def ols(x, y):
    """Coefficients, standard errors, residual sum of squares, by the whole matrix."""
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    rss = ((y - x @ b) ** 2).sum()
    return b, np.sqrt(np.diag(inverse) * rss / (len(y) - x.shape[1])), rss


def long_series(spark, x, step=1):
    rows = spark.createDataFrame([("a", i * step, float(v)) for i, v in enumerate(x)], "k string, pos long, value double")
    return rows.withColumn("ts", F.expr("date_add(date'2000-01-01', cast(pos as int))"))


def test_regressions_use_all_points_of_long_series(spark):
    rng = np.random.default_rng(3)
    n = 6000  # above the bound of 5000 there was
    x = np.cumsum(rng.normal(size=n)) * 0.1 + rng.normal(size=n)
    s, d = long_series(spark, x), np.diff(x)
    r = series.adf(s, ["k"]).first()
    p = r["lags"]
    b, se, _ = ols(np.column_stack([np.ones(n - 1 - p), x[p:-1], *(d[p - i : n - 1 - i] for i in range(1, p + 1))]), d[p:])
    assert r["statistic"] == pytest.approx(b[1] / se[1], rel=1e-6)
    top = int(np.ceil(12 * (n / 100) ** 0.25))
    rss = [ols(np.column_stack([np.ones(n - 1 - top), x[top:-1], *(d[top - i : n - 1 - i] for i in range(1, q + 1))]), d[top:])[2] for q in range(top + 1)]
    assert p == np.argmin([(n - 1 - top) * np.log(v / (n - 1 - top)) + 2 * (q + 2) for q, v in enumerate(rss)])
    cause = np.concatenate(([0.0], x[:-1])) + rng.normal(size=n)
    df = spark.createDataFrame([("a", i, float(u), float(v)) for i, (u, v) in enumerate(zip(cause, x))], "k string, t long, y double, x double")
    r = series.granger(df, "t", "y", ["x"], ["k"]).first()
    k = r["lags"]
    own = [np.ones(n - k), *(cause[k - i : n - i] for i in range(1, k + 1))]
    r0, r1 = ols(np.column_stack(own), cause[k:])[2], ols(np.column_stack([*own, *(x[k - i : n - i] for i in range(1, k + 1))]), cause[k:])[2]
    assert r["chi2"] == pytest.approx((n - k) * (r0 - r1) / r1, rel=1e-6)


def test_zivot_andrews_tries_every_break(spark):
    rng = np.random.default_rng(4)
    n = 700
    x = np.cumsum(rng.normal(size=n)) + np.where(np.arange(n) >= 333, 9, 0)
    d, k = np.diff(x), int(np.ceil(12 * (n / 100) ** 0.25)) // 2
    trend = np.arange(k, n - 1)
    lags = [d[k - i : n - 1 - i] for i in range(1, k + 1)]
    found = []
    for cut in range(int(0.15 * n), int(0.85 * n)):
        b, se, _ = ols(np.column_stack([np.ones(n - 1 - k), trend, x[k:-1], (trend >= cut) * 1.0, *lags]), d[k:])
        found.append((b[2] / se[2], cut))
    r = series.zivot_andrews(long_series(spark, x, 3), ["k"]).first()
    assert r["statistic"] == pytest.approx(min(found)[0], rel=1e-6) and r["break_pos"] == 3 * min(found)[1]


def test_shifts_spectrum_and_stl_see_every_day(spark):
    rng = np.random.default_rng(5)
    n = 2400
    x = rng.normal(size=n) + np.where((np.arange(n) >= 901) & (np.arange(n) < 1303), 6, 0)
    assert [r["pos"] for r in series.mean_shifts(long_series(spark, x), ["k"]).collect()] == [901, 1303]
    # a shift a penalty of 2 var ln n hides, and one of var ln n shows
    y = np.where(np.arange(400) < 200, 0.0, 0.3) + np.where(np.arange(400) % 2, -1, 1)
    gain, penalty = 400 * 0.0225, y.var() * np.log(400)
    assert penalty < gain < 2 * penalty
    assert [r["pos"] for r in series.mean_shifts(long_series(spark, y), ["k"]).collect()] == [200]
    wave = np.sin(2 * np.pi * np.arange(6000) / 7)
    parts = series.stl(long_series(spark, wave), ["k"], 7).orderBy("pos").toPandas()
    assert list(parts.pos) == list(range(6000)) and np.corrcoef(parts.seasonal, wave)[0, 1] > 0.99
    assert series.spectrum(
        long_series(spark, np.sin(2 * np.pi * np.arange(70_000) / 7)), ["k"]
    ).filter("rank = 1").first()["period"] == pytest.approx(7, rel=1e-3)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_insights_and_batches_read_the_table(spark, tmp_path):
    rows = catalog.queries()["f22_analysis_batch"](spark, str(DATA)).collect()
    assert {r["analysis"] for r in rows} == {"profile", "missing", "quality", "correlations", "outliers"}
    assert all(r["result"].startswith("{") for r in rows) and len(rows) > 5
    prices = [(float(2 ** (i % 20)),) for i in range(400)]
    spark.createDataFrame(prices, "o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert any("skewness" in r["message"] for r in catalog.queries()["n02_from_distribution"](spark, str(tmp_path)).collect())
