"""A value with a third of all rows or more: results as by brute force, and no task that holds its rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import assoc, outliers, ranks, steps


def largest_partition(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(6000) < 0.5, 0.0, np.round(rng.normal(size=6000), 2))
    v[::97] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": rng.normal(size=6000), "i": np.arange(6000)}))
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(8), v


def test_ranks_and_codes(spark, skewed):
    df, v = skewed
    want = pd.Series(v).rank()
    for ranges in (4, 40, ranks.RANK_RANGES):
        got = [r["r"] for r in ranks.with_rank(df, "v", "r", ranges).orderBy("i").collect()]
        assert [x if x is not None else -1 for x in got] == pytest.approx(want.fillna(-1).tolist())
    codes = {r["i"]: r["v"] for r in steps.label_encode(df, "v").collect()}
    order = sorted(set(v[~np.isnan(v)].tolist()))
    assert all(codes[i] == (order.index(x) if x == x else None) for i, x in enumerate(v.tolist()))


def test_frequent_value_is_spread_over_tasks(spark, skewed):
    df, _ = skewed
    counts = df.filter("v IS NOT NULL").groupBy(F.col("v").alias("__v")).agg(F.count(F.lit(1)).alias("__n")).withColumn("x", F.lit(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, x in zip(before, ("-1", "16", "false")):
            spark.conf.set(k, x)
        out = ranks.join_on_value(df, "v", counts, share=200, least=10)
        assert out.count() == 6000 and out.filter("x = 1").count() == df.filter("v IS NOT NULL").count()
        assert largest_partition(out) < 1200  # half of the rows are one value
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_kendall_with_a_frequent_value(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(900) < 0.5, 0.0, np.round(rng.normal(size=900), 1))
    y = np.where(rng.random(900) < 0.4, 1.0, np.round(x + rng.normal(size=900), 2))
    s = sum(float((np.sign(x[i + 1 :] - x[i]) * np.sign(y[i + 1 :] - y[i])).sum()) for i in range(900))
    pairs = 900 * 899 / 2
    tie = lambda v: sum(t * (t - 1) / 2 for t in np.unique(v, return_counts=True)[1])
    tau = s / np.sqrt((pairs - tie(x)) * (pairs - tie(y)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for rows in (10, 60, 100_000):
        assert assoc.kendall(df, "x", "y", rows).first()["tau"] == pytest.approx(tau)


def brute_noise(z, eps, least):
    d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(2) <= eps * eps
    core = d.sum(1) >= least
    return core, ~(d & core[None, :]).any(1)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
@pytest.mark.parametrize("heavy", [10_000, 20])
def test_density_noise(spark, k, heavy, monkeypatch):
    monkeypatch.setattr(outliers, "HEAVY_CELL", heavy)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(250, k)), rng.normal(scale=0.01, size=(200, k)) + 1, np.repeat(rng.normal(size=(2, k)), 6, axis=0), rng.normal(scale=4, size=(30, k))])
    df = spark.createDataFrame(pd.DataFrame({f"c{i}": x[:, i] for i in range(k)}).assign(i=range(len(x))))
    z = (x - x.mean(0)) / x.std(0)
    eps = 0.15 * k
    core, noise = brute_noise(z, eps, 5)
    got = outliers.density_noise(df, [f"c{i}" for i in range(k)], "i", eps).orderBy("i").collect()
    assert [r["core"] for r in got] == core.tolist() and [r["noise"] for r in got] == noise.tolist()
    assert noise.any() and core.any()


def test_density_noise_of_a_crowded_cell(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(scale=1e-4, size=(60_000, 2)), rng.normal(scale=3, size=(2000, 2))])
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "i": np.arange(len(x))}))
    got = outliers.density_noise(df, ["a", "b"], "i", 0.1)
    assert got.count() == len(x) and got.filter("core AND i < 60000").count() == 60_000


@pytest.mark.parametrize("strategy", ["ffill", "bfill"])
def test_fills_without_partitions_run_in_ranges(spark, strategy):
    v = pd.Series(np.where(np.random.default_rng(6).random(3000) < 0.98, np.nan, np.arange(3000.0)))
    df = spark.createDataFrame(pd.DataFrame({"v": v, "i": np.arange(3000)})).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)
    got = [r["v"] for r in steps.fill(df, "v", strategy, order_by="i").orderBy("i").collect()]
    want = v.ffill() if strategy == "ffill" else v.bfill()
    assert [x if x is not None else -1 for x in got] == want.fillna(-1).tolist()
