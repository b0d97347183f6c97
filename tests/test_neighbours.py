"""Numbers of neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import outliers


@pytest.mark.parametrize("k", [1, 2, 4])
@pytest.mark.parametrize("block", [5000, 7])
def test_neighbour_counts(spark, monkeypatch, k, block):
    monkeypatch.setattr(outliers, "BLOCK_POINTS", block)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(150, k)), rng.normal(scale=0.01, size=(60, k)) + 1, np.repeat(rng.normal(size=(2, k)), 6, axis=0)])
    df = spark.createDataFrame(pd.DataFrame({f"c{i}": x[:, i] for i in range(k)}).assign(i=range(len(x))))
    z = (x - x.mean(0)) / x.std(0)
    eps = 0.15 * k
    want = (((z[:, None, :] - z[None, :, :]) ** 2).sum(2) <= eps * eps).sum(1)
    got = outliers.density_noise(df, [f"c{i}" for i in range(k)], "i", eps, counts=True).orderBy("i").collect()
    assert [r["neighbours"] for r in got] == want.tolist()
    assert [r["core"] for r in got] == (want >= 5).tolist()
