"""Mutual information by nearest neighbours against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import importance

EULER = 0.5772156649015329


def psi(n):
    return -EULER + sum(1 / i for i in range(1, int(n)))


def brute(x, y, k=3):
    total = parts = 0.0
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    for i in range(len(x)):
        mates = np.flatnonzero((y == y[i]) & (np.arange(len(x)) != i))
        kk = min(k, len(mates))
        d = np.sort(np.abs(x[mates] - x[i]))
        r = d[kk - 1]
        if r > 0:
            m = ((x < x[i] + r) & (x > x[i] - r)).sum()
        else:
            kk, m = (d == 0).sum(), (x == x[i]).sum() - 1
        parts += psi(kk) - psi(len(mates) + 1) - psi(m)
        total += 1
    return max(0.0, psi(total) + parts / total)


@pytest.mark.parametrize("size", [7, 100_000])
def test_nearest_neighbours(spark, size, monkeypatch):
    rng = np.random.default_rng(7)
    n = 2000
    y = np.where(rng.random(n) < 0.03, "rare", np.where(rng.random(n) < 0.4, "a", "b"))
    y[5] = "single"
    a = rng.normal(size=n) + (y == "a") * 2 - (y == "rare") * 9
    x = pd.DataFrame({"close": a, "noise": rng.normal(size=n), "whole": np.round(a), "flag": (rng.random(n) < 0.5) * 1.0, "y": y})
    monkeypatch.setattr(importance, "ORDER_BUCKETS", 128 if size > 7 else 9)
    df = spark.createDataFrame(x)
    items = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.col("y").alias("y")) for c in x.columns[:4]))
    got = {r["feature"]: r["mi"] for r in importance.nearest_information(df.select(F.explode(items).alias("i")).select("i.*"), size=size).collect()}
    for c in x.columns[:4]:
        assert got[c] == pytest.approx(brute(x[c].to_numpy(), y), abs=1e-9)
    assert got["close"] > 0.3 > got["noise"]


def test_kinds_of_pairs(spark):
    rng = np.random.default_rng(8)
    x = pd.DataFrame({"u": rng.normal(size=400), "c": rng.choice(["p", "q"], 400), "e": rng.choice(["s", "t"], 400)})
    x["t"] = x.u + (x.c == "p")
    got = {r["feature"]: r["mi"] for r in importance.mutual_information(spark.createDataFrame(x), "t", ["u", "c"]).collect()}
    assert got["u"] > 0.3 and got["c"] == pytest.approx(brute(x.t.to_numpy(), x.c.to_numpy()), abs=1e-9)
    got = {r["feature"]: r["mi"] for r in importance.mutual_information(spark.createDataFrame(x), "c", ["u", "e"]).collect()}
    joint = pd.crosstab(x.c, x.e).to_numpy() / 400
    want = (joint * np.log(joint / joint.sum(0) / joint.sum(1)[:, None])).sum()
    assert got["e"] == pytest.approx(want) and got["u"] == pytest.approx(brute(x.u.to_numpy(), x.c.to_numpy()), abs=1e-9)
