"""Series cut into many blocks against the same statistics in one piece of plain numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import longseries as L
from tidewell.operators import series as S

N = 700


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(21)
    walk = np.cumsum(rng.normal(size=N))
    wave = np.sin(np.arange(N) / 5) + rng.normal(size=N) / 3
    shift = np.concatenate([rng.normal(size=300), 4 + rng.normal(size=400)])
    return {"walk": walk, "wave": wave, "shift": np.round(shift, 1), "short": wave[:40], "flat": np.ones(50)}


@pytest.fixture(scope="module")
def table(spark, values):
    rows = [(k, i, float(v), "x") for k, x in values.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, pos long, value double, first string").drop("first")
    return df.withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600)).repartition(4)


def same(got, want, columns):
    a, b = ({r["k"]: [r[c] for c in columns] for r in x.collect()} for x in (got, want))
    assert set(a) == set(b)
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-7, abs=1e-10)


def lstsq(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = ((y - x @ b) ** 2).sum()
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / (len(y) - x.shape[1])), rss


def plain_adf(v):
    n, d = len(v), np.diff(v)
    top = L.most_lags(n)
    rows = lambda p, first: (np.column_stack([np.ones(n - 1 - first), v[first : n - 1], *(d[first - i : n - 1 - i] for i in range(1, p + 1))]), d[first:])
    aic = []
    for p in range(top + 1):
        x, y = rows(p, top)
        aic.append((len(y) * np.log(lstsq(x, y)[2] / len(y)) + 2 * (p + 2), p))
    p = min(aic)[1]
    b, se, _ = lstsq(*rows(p, p))
    return b[1] / se[1], p


@pytest.mark.parametrize("size", [50, 137, 100_000])
def test_adf(table, values, size):
    got = {r["k"]: r for r in L.adf(table, ["k"], size).collect()}
    assert set(got) == {"walk", "wave", "shift", "short"}
    for k in got:
        t, p = plain_adf(values[k])
        assert (got[k]["statistic"], got[k]["lags"]) == (pytest.approx(t, rel=1e-8), p)


def plain_kpss(v):
    n, e = len(v), v - v.mean()
    s0, s1 = e @ e / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lag = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    var = (e @ e + 2 * sum((1 - i / (lag + 1)) * (e[i:] @ e[: n - i]) for i in range(1, lag + 1))) / n
    return (np.cumsum(e) ** 2).sum() / (n * n * var), lag


@pytest.mark.parametrize("size", [20, 100_000])
def test_kpss(table, values, size):
    for r in L.kpss(table, ["k"], size).collect():
        stat, lag = plain_kpss(values[r["k"]])
        assert (r["statistic"], r["lags"]) == (pytest.approx(stat, rel=1e-9), lag) and 0.01 <= r["p"] <= 0.1


def plain_zivot(v):
    n, k = len(v), int(np.ceil(12 * (len(v) / 100) ** 0.25)) // 2
    d, best = np.diff(v), []
    for cut in range(int(0.15 * n), int(0.85 * n)):
        at = np.arange(k, n - 1)
        x = np.column_stack([np.ones(len(at)), at / n, v[k : n - 1], *(d[k - i : n - 1 - i] for i in range(1, k + 1)), (at >= cut).astype(float)])
        b, se, _ = lstsq(x, d[k:])
        best.append((b[2] / se[2], cut))
    return min(best)


@pytest.mark.parametrize("size", [60, 100_000])
def test_zivot_andrews(table, values, size):
    got = {r["k"]: r for r in L.zivot_andrews(table.filter("k IN ('shift', 'short')"), ["k"], size).collect()}
    for k in got:
        t, cut = plain_zivot(values[k])
        assert (got[k]["statistic"], got[k]["break_pos"]) == (pytest.approx(t, rel=1e-6), cut)


@pytest.mark.parametrize("size", [30, 100_000])
def test_granger(spark, values, size):
    rng = np.random.default_rng(3)
    y, n = np.zeros(N), N
    x = rng.normal(size=N)
    for i in range(2, N):
        y[i] = 0.4 * y[i - 1] + 0.6 * x[i - 2] + rng.normal() / 4
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": np.arange(N), "value": y, "x": x, "z": rng.normal(size=N)}))
    for r in L.granger(df, ["k"], ["x", "z"], size).collect():
        other, k = np.array([v[0] for v in df.orderBy("pos").select(r["other"]).collect()]), r["lags"]
        lags = lambda v: [v[k - i : n - i] for i in range(1, k + 1)]  # noqa: E731, B023
        r0 = lstsq(np.column_stack([np.ones(n - k), *lags(y)]), y[k:])[2]
        r1 = lstsq(np.column_stack([np.ones(n - k), *lags(y), *lags(other)]), y[k:])[2]
        assert r["chi2"] == pytest.approx((n - k) * (r0 - r1) / r1, rel=1e-7)
        assert (r["p"] < 1e-9) == (r["other"] == "x")


@pytest.mark.parametrize("size", [61, 100_000])
def test_lags(table, values, size):
    for r in S.autocorrelation(table, ["k"], size).collect():
        e = values[r["k"]] - values[r["k"]].mean()
        lag = r["lag"]
        want = (e[lag:] @ e[: len(e) - lag]) / (e @ e) if e.any() else None
        assert r["acf"] == (pytest.approx(want, abs=1e-10) if want is not None else None)
    for f, ranked in ((S.lag_correlations, False), (S.lag_rank_correlations, True)):
        found = f(table, ["k"], size=size).collect()
        assert {r["lag"] for r in found if r["k"] == "walk"} == set(range(1, 21)) and {r["lag"] for r in found if r["k"] == "short"} == set(range(1, 9))
        for r in found:
            v, lag = pd.Series(values[r["k"]]), r["lag"]
            a, b = v[lag:].reset_index(drop=True), v[: len(v) - lag]
            a, b = (a.rank(), b.rank()) if ranked else (a, b)
            got = r["spearman" if ranked else "pearson"]
            assert got is None if r["k"] == "flat" else got == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_lags_pass_over_places_without_a_value(table):
    holes = table.filter("k = 'wave'").withColumn("value", F.expr("IF(pos % 7 = 3, NULL, value)"))
    v = np.array([r["value"] if r["value"] is not None else np.nan for r in holes.orderBy("pos").collect()], float)
    for r in S.lag_correlations(holes, ["k"], 5, 40).collect():
        a, b = v[r["lag"] :], v[: -r["lag"]]
        ok = ~(np.isnan(a) | np.isnan(b))
        assert r["pearson"] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1])


@pytest.mark.parametrize("size", [33, 100_000])
def test_scans(table, values, size):
    odd = table.withColumn("value", F.expr("IF(k = 'wave' AND (pos < 40 OR pos % 5 = 0), NULL, value)"))
    got = {(r["k"], r["pos"]): r["ewma"] for r in L.ewma(odd, ["k"], size=size).collect()}
    for k, v in values.items():
        alpha, now = 2 / (max(2, len(v) // 10) + 1), None
        for i, x in enumerate(v):
            if not (k == "wave" and (i < 40 or i % 5 == 0)):
                now = x if now is None else (1 - alpha) * now + alpha * x
            assert got[k, i] == (pytest.approx(now, rel=1e-9, abs=1e-12) if now is not None else None)
    rows = {(r["k"], r["pos"]): r for r in L.cusum(table, ["k"], 0.1, size).collect()}
    sums = {(r["k"], r["pos"]): r["total"] for r in L.running_sums(table, ["k"], {"total": F.col("value")}, size).collect()}
    for k, v in values.items():
        up = down = 0.0
        for i, x in enumerate(v - v.mean()):
            up, down = (0.0, 0.0) if i == 0 else (max(0.0, up + x - 0.1), max(0.0, down - x - 0.1))
            assert (rows[k, i]["up"], rows[k, i]["down"]) == (pytest.approx(up, abs=1e-9), pytest.approx(down, abs=1e-9))
            assert sums[k, i] == pytest.approx(v[: i + 1].sum(), abs=1e-9)


def every_partition(x, least, penalty):
    n = len(x)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for j in range(least, n + 1):
        costs = [best[a] + ((x[a:j] - x[a:j].mean()) ** 2).sum() + penalty for a in range(j - least + 1)]
        back[j] = int(np.argmin(costs))
        best[j] = costs[back[j]]
    cuts, j = [], n
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def test_pruned_partition_is_the_best():
    rng = np.random.default_rng(5)
    for trial in range(40):
        n = int(rng.integers(20, 160))
        x = rng.normal(size=n) + np.repeat(rng.normal(scale=2, size=n), rng.integers(1, 30, n))[:n]
        for least in (2, 7, n // 20 or 1, n // 3):
            penalty = float(x.var() * np.log(n)) * (0.2 if trial % 2 else 1)
            assert S._shifts(x, max(1, least), penalty) == every_partition(x, max(1, least), penalty)


def test_pruning_is_near_linear():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 1, 25_000) for m in (0, 0.5, -0.5, 1)])
    cuts = S._shifts(x, len(x) // 20, float(x.var() * np.log(len(x))))
    assert len(cuts) == 4 and all(abs(c - w) < 60 for c, w in zip(cuts, (25_000, 50_000, 75_000, 100_000)))


def test_inversions_and_sen_slope(monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 30, 400).astype(float)
    assert S.inversions(v) == sum(int((v[i + 1 :] < v[i]).sum()) for i in range(400))
    i, j = np.triu_indices(900, 1)
    for v in (rng.normal(size=900), np.cumsum(rng.normal(size=900)), rng.integers(0, 3, 900).astype(float), np.arange(900.0), np.zeros(900)):
        x = np.sort(rng.choice(3000, 900, replace=False)).astype(float)
        want = float(np.median((v[j] - v[i]) / (x[j] - x[i])))
        monkeypatch.setattr(S, "MOST_PAIRS", 3000)
        assert S.sen_slope(x, v) == pytest.approx(want, rel=1e-9, abs=1e-12)
        monkeypatch.setattr(S, "MOST_PAIRS", 4_000_000)


def test_mann_kendall_of_a_long_series(spark):
    n = 60_000
    v = np.arange(n) * 0.25 + np.random.default_rng(2).normal(size=n) * 50
    s = spark.createDataFrame(pd.DataFrame({"k": "a", "pos": np.arange(n), "value": v}))
    [r] = S.mann_kendall(s, ["k"]).collect()
    assert r["s"] > 0.9 * n * (n - 1) / 2 and r["slope"] == pytest.approx(0.25, abs=1e-3) and r["p"] < 1e-12
