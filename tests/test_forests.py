"""Forests: cuts, weights, out-of-bag rows; Shapley values and interactions against all coalitions."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import forests as T

K = 6


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(500, K)), 1)
    x[:, 5] = rng.integers(0, 2, 500)
    y = 3 * x[:, 0] * (x[:, 1] > 0) + x[:, 2] + 0.1 * rng.normal(size=500)
    x[400:], y[400:] = x[0], y[0]  # a fifth of the rows are copies
    return x, y


def matrix(spark, x, y):
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(v.tolist(), float(z)) for v, z in zip(x, y)], "x array<double>, label double").repartition(5)
    return df.select(array_to_vector("x").alias("features"), "label")


NAMES = [f"c{i}" for i in range(K)]


@pytest.fixture(scope="module")
def regression(spark, rows):
    return T.grow(matrix(spark, *rows), NAMES, False, trees=4, depth=6)


@pytest.fixture(scope="module")
def classes(spark, rows):
    x, y = rows
    return T.grow(matrix(spark, x, (y > 0).astype(float) + (y > 2)), NAMES, True, trees=5, depth=5)


def expectation(model, tree, row, known):
    t = model.grown[tree]

    def at(node):
        f = t.feature[node]
        if f < 0:
            return model.value(t.stats[node])
        a, b = t.left[node], t.left[node] + 1
        if f in known:
            return at(b if row[f] > t.cut[node] else a)
        wa, wb = model.cover(t.stats[a]), model.cover(t.stats[b])
        return (wa * at(a) + wb * at(b)) / (wa + wb)

    return at(0)


def coalitions(model, row):
    every = [frozenset(s) for n in range(K + 1) for s in combinations(range(K), n)]
    return {s: np.mean([expectation(model, t, row, s) for t in range(len(model.grown))], axis=0) for s in every}


@pytest.mark.parametrize("which", ["regression", "classes"])
def test_shapley_values_and_interactions(request, rows, which):
    model = request.getfixturevalue(which)
    bins = model.bins(rows[0][:12])
    base, phi, both = T.explain(model, bins, pairs=True)
    f = math.factorial
    for r in range(len(bins)):
        v = coalitions(model, bins[r])
        assert np.allclose(base, v[frozenset()], atol=1e-12)
        for i in range(K):
            rest = [s for s in v if i not in s]
            want = sum(f(len(s)) * f(K - len(s) - 1) / f(K) * (v[s | {i}] - v[s]) for s in rest)
            assert np.allclose(phi[r, i], want, atol=1e-10)
            for j in range(K):
                if i != j:
                    apart = [s for s in rest if j not in s]
                    want = sum(f(len(s)) * f(K - len(s) - 2) / (2 * f(K - 1)) * (v[s | {i, j}] - v[s | {i}] - v[s | {j}] + v[s]) for s in apart)
                    assert np.allclose(both[r, i, j], want, atol=1e-10)
        assert np.allclose(both[r].sum(1), phi[r], atol=1e-12)


def test_values_add_up_to_the_prediction(spark, rows, regression, classes):
    for model, y in ((regression, rows[1]), (classes, rows[1])):
        for r in T.shapley_values(model, matrix(spark, rows[0], y)).limit(60).collect():
            total = np.array(r["base"]) + np.array(r["values"]).sum(0)
            assert np.allclose(total, r["prediction"], atol=1e-9)


def naive_cut(x, y, w, classes):
    """Best gain over all features and cut points at the root."""
    def impurity(m):
        if not w[m].sum():
            return 0.0
        if classes:
            n = np.array([w[m & (y == c)].sum() for c in range(classes)])
            return n.sum() - (n * n).sum() / n.sum()
        mean = (w[m] * y[m]).sum() / w[m].sum()
        return (w[m] * (y[m] - mean) ** 2).sum()

    every = np.ones(len(y), bool)
    return max(
        impurity(every) - impurity(x[:, j] <= c) - impurity(x[:, j] > c) for j in range(x.shape[1]) for c in range(int(x[:, j].max())) if w[x[:, j] <= c].sum() and w[x[:, j] > c].sum()
    )


def held(spark, data, k=K):
    found = data.collect()
    bins = np.array([list(r["bins"]) for r in found])
    return bins, np.array([r["label"] for r in found]), *(np.array([r[c] for r in found]) for c in ("key", "n", "skip"))


def test_root_cuts_are_the_best(spark, rows):
    data = T.binned(matrix(spark, *rows), NAMES, False)
    model = T.grow(matrix(spark, *rows), NAMES, False, trees=3, depth=1, rows=data)
    bins, y, key, n, skip = held(spark, data[0])
    row, keys, copy = T._copies(key, n, skip)
    w = model.weights(keys, copy)
    for t, tree in enumerate(model.grown):
        each = np.bincount(row, w[:, t], len(y))
        whole, left, right = (T._impurity(tree.stats[i], 0) for i in range(3))
        assert whole - left - right == pytest.approx(naive_cut(bins, y, each, 0), rel=1e-9)
        assert model.cover(tree.stats[0]) == each.sum()


def test_dense_and_sparse_sums_grow_the_same_trees(spark, rows, regression, monkeypatch):
    monkeypatch.setattr(T, "DENSE_CELLS", 500)
    monkeypatch.setattr(T, "MOST_WEIGHTS", 100)
    again = T.grow(matrix(spark, *rows), NAMES, False, trees=4, depth=6)
    assert [(t.feature, t.cut, t.left) for t in again.grown] == [(t.feature, t.cut, t.left) for t in regression.grown]


def test_copies_are_dealt_over_records(spark, rows, monkeypatch):
    x, y = rows
    monkeypatch.setattr(T, "MOST_COPIES", 7)
    data, _, _ = T.binned(matrix(spark, x, y), NAMES, False)
    _, _, key, n, skip = held(spark, data)
    assert n.sum() == 500 and n.max() <= 7
    assert len(set(zip(key.tolist(), skip.tolist()))) == len(n) and sorted(skip[key == key[n.argmax()]].tolist())[:3] == [0, 7, 14]


def test_out_of_bag_scores(spark, rows, regression):
    data = T.binned(matrix(spark, *rows), NAMES, False)
    bins, y, key, n, skip = held(spark, data[0])
    row, keys, copy = T._copies(key, n, skip)
    out = regression.weights(keys, copy) == 0
    values = np.stack([[regression.value(t.stats[i])[0] for i in T._nodes([t.arrays()], bins, 64)[:, 0]] for t in regression.grown], axis=1)[row]
    seen = out.any(1)
    guess, real = (values * out).sum(1)[seen] / out.sum(1)[seen], y[row][seen]
    [got] = T.held_out_scores(regression, data[0]).collect()
    assert got["n"] == seen.sum() and got["score"] == pytest.approx(1 - ((real - guess) ** 2).sum() / ((real - real.mean()) ** 2).sum())
    assert 0.3 < out.mean() < 0.44 and got["score"] > 0.5


def test_folds_and_refits(spark, rows):
    x, y = rows
    df = matrix(spark, x, (y > 0).astype(float))
    data = T.binned(df, NAMES, True)
    model = T.grow(df, NAMES, True, trees=5, depth=5, refits=4, kind="folds", rows=data)
    scores = T.held_out_scores(model, data[0]).collect()
    assert len(scores) == 4 and sum(r["n"] for r in scores) == 500 and all(r["score"] > 0.75 for r in scores)
    _, _, key, n, skip = held(spark, data[0])
    _, keys, copy = T._copies(key, n, skip)
    fold, w = model.folds(keys, copy), model.weights(keys, copy)
    for f in range(4):
        assert not w[fold == f, f * 5 : f * 5 + 5].any() and w[fold != f, f * 5 : f * 5 + 5].mean() == pytest.approx(1, abs=0.1)
    drawn = T.grow(df, NAMES, True, trees=5, depth=4, refits=3, kind="bootstrap", rows=data)
    per = T.importances(drawn)
    assert per.shape == (3, K) and np.allclose(per.sum(1), 1) and per[:, 0].min() > per[:, 3].max()
    assert T.stability(drawn, df).count() == K
    assert drawn.weights(keys, copy).mean() == pytest.approx(1, abs=0.1)


def test_mean_abs_over_all_copies(spark, rows, regression):
    data, _, _ = T.binned(matrix(spark, *rows), NAMES, False)
    _, phi, both = T.explain(regression, regression.bins(rows[0]), pairs=True)
    want = np.abs(phi[:, :, 0]).mean(0)
    assert {r["feature"]: r["importance"] for r in T.mean_abs_shapley(regression, data).collect()} == pytest.approx(dict(zip(NAMES, want)))
    pairs = {(r["feature_a"], r["feature_b"]): r for r in T.interactions(regression, data, ["c1", "c0", "c2"]).collect()}
    assert set(pairs) == {("c1", "c0"), ("c1", "c2"), ("c0", "c2")}
    assert pairs["c1", "c0"]["strength"] == pytest.approx(np.abs(both[:, 1, 0, 0]).mean())
    assert pairs["c1", "c0"]["a_alone"] == pytest.approx(np.abs(both[:, 1, 1, 0]).mean())


def test_odd_matrices(spark):
    one = matrix(spark, np.ones((5, K)), np.ones(5))
    model = T.grow(one, NAMES, False, trees=2, depth=3)
    assert all(t.feature == [-1] for t in model.grown) and T.predict(model, np.ones((1, K)))[0, 0] == 1
    empty = T.grow(one.limit(0), NAMES, True, trees=2, depth=3)
    assert T.mean_abs_shapley(empty, T.binned(one.limit(0), NAMES, True)[0]).filter(F.col("importance") > 0).count() == 0


def test_explained_rows_are_dealt_over_tasks(spark, rows, regression, monkeypatch):
    """k18, k16: a task for so many different rows each; the tables serve all blocks of a task."""
    data, _, _ = T.binned(matrix(spark, *rows), NAMES, False)
    want = {r["feature"]: r["importance"] for r in T.mean_abs_shapley(regression, data).collect()}
    monkeypatch.setattr(T, "EXPLAINED_ROWS", 50)
    monkeypatch.setattr(T, "TABLE_CELLS", 500)
    equal = T.equal_rows(data)
    assert equal.rdd.getNumPartitions() == -(-equal.count() // 50) > 4
    assert {r["feature"]: r["importance"] for r in T.mean_abs_shapley(regression, data).collect()} == pytest.approx(want, rel=1e-12)
    bins = regression.bins(rows[0])
    by = T.grouped(regression)
    parts = [T.explain(regression, bins[i : i + 90], True, by) for i in range(0, len(bins), 90)]
    for c in (1, 2):
        assert np.allclose(np.concatenate([p[c] for p in parts]), T.explain(regression, bins, True)[c], atol=1e-13)


def test_a_leaf_that_no_row_reaches():
    model = T.Forest(["a"], [], 0, 1, 1, "one", 0, [T.Tree([0, -1, 0, -1, -1], [3, 0, 2, 0, 0], [1, -1, 3, -1, -1], [np.array([4.0, 4, 0]), np.array([2.0, 0, 0]), np.array([2.0, 4, 0]), np.array([1.0, 1, 0]), np.array([1.0, 3, 0])])])
    base, phi, _ = T.explain(model, np.array([[0], [3], [4], [64]], np.uint8))
    assert base[0] == 1 and phi[:, 0, 0].tolist() == [-1, -1, 2, 2]


@pytest.mark.parametrize("name", ["k16_mean_abs_shapley", "k18_interactions"])
def test_texts_are_read_once(spark, monkeypatch, name):
    """The rows a forest is grown from come from features that are written out, not from the texts again."""
    from tidewell.plans import catalog

    def seen(matrix, *_, **__):
        raise InterruptedError(" ".join(matrix.inputFiles()))

    monkeypatch.setattr(T, "binned", seen)
    with pytest.raises(InterruptedError) as e:
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert "features" in str(e.value) and "documents" not in str(e.value)


def test_grown_rows_are_dealt_over_tasks(spark, rows, monkeypatch):
    """k06: copies are weighed and scored by as many tasks as their number asks for, with the same trees."""
    one, _, _ = T.binned(matrix(spark, *rows), NAMES, False)
    monkeypatch.setattr(T, "GROWN_ROWS", 100)
    data = T.binned(matrix(spark, *rows), NAMES, False)
    assert data[0].rdd.getNumPartitions() == 5 and data[0].exceptAll(one).isEmpty() and one.exceptAll(data[0]).isEmpty()


def test_pairs_explain_the_rows_once(spark, rows, regression):
    """k18: the strength of a pair and of both sides alone come from one pass over the rows."""
    data, _, _ = T.binned(matrix(spark, *rows), NAMES, False)
    plan = T.interactions(regression, data, NAMES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow made(") == 1
