"""Random forests whose structure is ours to use: grown level by level, scored out of bag, explained exactly.

*Growing.* Features are cut at quantiles; equal rows (of binned features and label) become
one row with its copies. All trees of all refits grow at once: per level one pass sums, for
each open node, the labels by feature and bin, a second step picks the best cuts per tree,
and only those (at most trees x nodes) reach the driver. Every copy of a row has a weight in
every tree, Poisson numbers that follow from a hash of (row, copy, tree); so any later pass
knows which trees have not seen a copy.

*Shapley values* are those of the path-dependent expectation: where a feature is unknown, a
tree's children count by their cover. Along a root-to-leaf path each feature ``j`` has a
share ``z_j`` of the cover that its cuts let through and a flag ``o_j``, whether the row
passes them. A leaf with value ``v`` gives ``j``

    v (o_j - z_j) * integral over s in [0, 1] of the product over i != j of (z_i (1 - s) + o_i s)

as the integral of s^a (1 - s)^b is the Shapley weight of a coalition. The product is a
polynomial in ``s``, so Gauss-Legendre nodes make the integral exact. Only the flags depend
on the row: each leaf has a table by flag pattern, and a batch of rows looks its patterns up.
Interactions of two features leave both out of the product and take half of
``(o_i - z_i) (o_j - z_j)``; main effects are what remains of the Shapley value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Poisson distribution functions for a mean of 0..8; larger means (a refit's draw) are as good as never seen.
_CUTS = np.array([np.cumsum([np.exp(-m) * m**i / np.prod(np.arange(1, i + 1), dtype=float) for i in range(24)]) for m in range(9)])
#: Cells of a task's dense histogram; beyond that it is kept sparse.
DENSE_CELLS = 4_000_000
#: Copies of one row in one record, and copies times trees weighed at a time.
MOST_COPIES, MOST_WEIGHTS = 4096, 2_000_000
#: Copies of rows in a task that grows trees, different rows in one that explains them, numbers in tables by flag pattern made at a time.
GROWN_ROWS, EXPLAINED_ROWS, TABLE_CELLS = 25_000, 4096, 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> U64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Tree:
    """Nodes in the order of their making; the right child follows the left one. ``feature`` is -1 in leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    stats: list = field(default_factory=lambda: [None])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


@dataclass
class Forest:
    """``refits`` forests of ``trees`` trees over the same binned rows.

    ``kind``: ``one`` (a plain forest), ``bootstrap`` (each refit draws its rows first) or
    ``folds`` (refit ``f`` leaves fold ``f`` out).
    """

    names: list[str]
    edges: list[np.ndarray]
    classes: int  # 0: regression
    trees: int
    refits: int
    kind: str
    seed: int
    grown: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def value(self, stats: np.ndarray) -> np.ndarray:
        """Class shares, or the mean."""
        return stats / stats.sum() if self.classes else stats[1:2] / stats[0]

    def cover(self, stats: np.ndarray) -> float:
        return float(stats.sum() if self.classes else stats[0])

    def weights(self, key: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """Copies x trees of all refits: how often each tree has each copy."""
        base = mix(key.astype(U64) + copy.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(self.seed))
        tree = np.arange(1, self.refits * self.trees + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95)
        u = uniform(base[:, None] + tree[None, :])
        if self.kind == "one":
            return np.searchsorted(_CUTS[1], u)
        refit = np.arange(1, self.refits + 1, dtype=np.uint64) * U64(0x2545F4914F6CDD1D)
        if self.kind == "folds":
            fold = (mix(base ^ U64(77)) % U64(self.refits)).astype(int)
            mean = (fold[:, None] != np.arange(self.refits)[None, :]).astype(int)
        else:
            mean = np.minimum(np.searchsorted(_CUTS[1], uniform(base[:, None] + refit[None, :])), len(_CUTS) - 1)
        out = np.zeros(u.shape, int)
        mean = np.repeat(mean, self.trees, axis=1)
        for m in range(1, int(mean.max(initial=0)) + 1):
            out[mean == m] = np.searchsorted(_CUTS[m], u[mean == m])
        return out

    def folds(self, key: np.ndarray, copy: np.ndarray) -> np.ndarray:
        base = mix(key.astype(U64) + copy.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(self.seed))
        return (mix(base ^ U64(77)) % U64(self.refits)).astype(int)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long arrays of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def binned(matrix: DataFrame, names: list[str], classification: bool, bins: int = 64) -> tuple[DataFrame, list[np.ndarray], int]:
    """Rows (bins, label, key, n, skip), cut points per feature, number of classes.

    ``n`` copies of a binned row from number ``skip`` on; more than ``MOST_COPIES`` are
    dealt over several records, so that a group of equal rows is no hot spot.
    """
    from pyspark.ml.functions import vector_to_array

    x = matrix.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    points = [i / bins for i in range(1, bins)]
    seen = x.agg(F.max("label"), *(F.percentile_approx(F.element_at("x", i + 1), points, 10_000) for i in range(len(names))), F.count(F.lit(1))).first()
    edges = [np.unique(np.array(q or [], float)) for q in seen[1:-1]]
    classes = int(seen[0] or 0) + 1 if classification else 0
    model = Forest(names, edges, classes, 0, 0, "one", 0)
    k = len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = model.bins(_matrix(b.column(0), k))
                yield pa.record_batch({"bins": pa.array([r.tobytes() for r in found], pa.binary()), "label": b.column(1)})

    rows = x.mapInArrow(cut, "bins binary, label double").groupBy("bins", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("key", F.xxhash64("bins", "label"))
    few = rows.filter(F.col("n") <= MOST_COPIES).withColumn("skip", F.lit(0).cast("long"))
    many = rows.filter(F.col("n") > MOST_COPIES).withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(MOST_COPIES).cast("long"))))
    many = many.withColumn("n", F.least(F.lit(MOST_COPIES).cast("long"), F.col("n") - F.col("skip")))
    dealt = few.select("bins", "label", "key", "n", "skip").unionByName(many.select("bins", "label", "key", "n", "skip"))
    # few bytes, but much work a copy: without a number all would be put together in one task
    return dealt.repartition(max(1, -(-seen[-1] // GROWN_ROWS)), "key", "skip"), edges, classes


def _pieces(batches: Iterator[pa.RecordBatch], width: int, trees: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, label, key, n, skip) of few enough copies to be weighed at once."""
    for b in batches:
        if not b.num_rows:
            continue
        bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        label, key, n, skip = (b.column(c).to_numpy() for c in ("label", "key", "n", "skip"))
        at, ends = 0, np.cumsum(n)
        while at < len(n):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max(1, MOST_WEIGHTS // trees), "right")))
            yield bins[at:to], label[at:to], key[at:to], n[at:to], skip[at:to]
            at = to


def _copies(key: np.ndarray, n: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and copy number of each copy."""
    row = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n) - n
    return row, key[row], np.arange(len(row)) - starts[row] + skip[row]


def _nodes(arrays: list, bins: np.ndarray, steps: int) -> np.ndarray:
    """Rows x trees: the node each row has come to."""
    out = np.zeros((len(bins), len(arrays)), np.int64)
    every = np.arange(len(bins))
    for t, (feature, cut, left) in enumerate(arrays):
        at = out[:, t]
        for _ in range(steps):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[every, np.where(inner, f, 0)] > cut[at]
            at = np.where(inner, left[at] + right, at)
        out[:, t] = at
    return out


def _impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Weighted: Gini, or the sum of squares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            w = stats.sum(-1)
            return np.where(w > 0, w - (stats * stats).sum(-1) / w, 0.0)
        w, wy, wyy = stats[..., 0], stats[..., 1], stats[..., 2]
        return np.where(w > 0, np.maximum(wyy - wy * wy / w, 0.0), 0.0)


def _best(hist: np.ndarray, tries: np.ndarray, most: int, classes: int) -> tuple[np.ndarray, ...]:
    """Per node the best (try, bin), its gain and the stats on both sides; among the first ``most`` features that can be cut."""
    left = hist.cumsum(2)[:, :, :-1]
    total = hist[:, :1].sum(2, keepdims=True)
    right = total - left
    weight = (lambda s: s.sum(-1)) if classes else (lambda s: s[..., 0])
    ok = (weight(left) > 0.5) & (weight(right) > 0.5)
    gain = np.where(ok, _impurity(total, classes) - _impurity(left, classes) - _impurity(right, classes), -1.0)
    usable = ok.any(2)
    gain[~(usable & (np.cumsum(usable, 1) <= most))] = -1.0
    flat = gain.reshape(len(gain), -1).argmax(1)
    j, b = np.unravel_index(flat, gain.shape[1:])
    every = np.arange(len(gain))
    return tries[every, j], b, gain[every, j, b], left[every, j, b], right[every, j, b]


def _tries(model: Forest, tree: int, nodes: np.ndarray, candidates: int) -> np.ndarray:
    """Per node the features in the order in which they are tried."""
    k = len(model.names)
    h = mix(nodes.astype(U64)[:, None] * U64(0x9E3779B97F4A7C15) + U64(tree * 7919 + model.seed) + mix(np.arange(1, k + 1, dtype=np.uint64))[None, :])
    return np.argsort(h, axis=1, kind="stable")[:, :candidates]


def grow(
    matrix: DataFrame, names: list[str], classification: bool, trees: int = 25, depth: int = 10, refits: int = 1, kind: str = "one", bins: int = 64, seed: int = 42,
    rows: tuple[DataFrame, list[np.ndarray], int] | None = None
) -> Forest:
    """Grow all trees of all refits, a level at a time; the binned rows are kept in memory or on disk meanwhile.

    ``rows``: what :func:`binned` gave, if it is there already.
    """
    data, edges, classes = rows or binned(matrix, names, classification, bins)
    model = Forest(names, edges, classes, trees, refits, kind, seed, [Tree() for _ in range(trees * refits)])
    kept = not data.is_cached
    held = data.persist() if kept else data
    k, count = len(names), len(model.grown)
    most = max(1, int(k**0.5)) if classes else k
    candidates = min(k, max(32, 4 * most))
    stats = classes or 3
    width = bins + 1
    open_ = [np.array([0]) for _ in model.grown]
    try:
        for level in range(depth):
            if not any(map(len, open_)):
                break
            found = _level(model, held, open_, level, most, candidates, stats, width, k)
            for r in found:
                tree, node = model.grown[r["tree"]], r["node"]
                if tree.stats[node] is None:
                    tree.stats[node] = np.array(r["total"])
                if r["gain"] <= 1e-12 * max(1.0, model.cover(tree.stats[node])):
                    continue
                tree.feature[node], tree.cut[node], tree.left[node] = r["feature"], r["cut"], len(tree.feature)
                for side in ("left", "right"):
                    tree.feature.append(-1)
                    tree.cut.append(0)
                    tree.left.append(-1)
                    tree.stats.append(np.array(r[side]))
            open_ = [np.array(_still_open(model, t, open_[i]), np.int64) for i, t in enumerate(model.grown)]
    finally:
        if kept:
            held.unpersist()
    for t in model.grown:  # a tree that drew no row at all
        t.stats = [np.ones(stats) if s is None or model.cover(s) <= 0 else s for s in t.stats]
    return model


def _still_open(model: Forest, tree: Tree, parents: np.ndarray) -> list[int]:
    children = [c for p in parents.tolist() if tree.feature[p] >= 0 for c in (tree.left[p], tree.left[p] + 1)]
    return [c for c in children if model.cover(tree.stats[c]) > 1.5 and _impurity(tree.stats[c], model.classes) > 1e-9]


def _level(model: Forest, data: DataFrame, open_: list[np.ndarray], level: int, most: int, candidates: int, stats: int, width: int, k: int) -> list:
    count = len(model.grown)
    arrays = [t.arrays() for t in model.grown]
    tries = [_tries(model, i, nodes, candidates) for i, nodes in enumerate(open_)]
    slot = []
    for i, nodes in enumerate(open_):
        s = np.full(len(model.grown[i].feature), -1)
        s[nodes] = np.arange(len(nodes))
        slot.append(s)
    offset = np.concatenate([[0], np.cumsum([len(n) for n in open_])])  # cells of a tree follow those of the one before
    cell = candidates * width
    total_cells = int(offset[-1]) * cell

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((stats, total_cells)) if total_cells * stats <= DENSE_CELLS else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for bins, label, key, n, skip in _pieces(batches, k, count):
            row, keys, copy = _copies(key, n, skip)
            w = model.weights(keys, copy)
            w = np.add.reduceat(w, np.cumsum(n) - n, axis=0) if len(row) > len(n) else w
            at = _nodes(arrays, bins, level)
            for t in range(count):
                if not len(open_[t]):
                    continue
                s = slot[t][at[:, t]]
                r = np.flatnonzero((s >= 0) & (w[:, t] > 0))
                if not len(r):
                    continue
                s, wt = s[r], w[r, t].astype(float)
                chosen = tries[t][s]
                code = ((offset[t] + s)[:, None] * candidates + np.arange(candidates)[None, :]) * width + bins[r[:, None], chosen]
                each = np.repeat(wt, candidates)
                y = np.repeat(label[r], candidates)
                parts = [each * (y == c) for c in range(stats)] if model.classes else [each, each * y, each * y * y]
                if dense is not None:
                    for c in range(stats):
                        dense[c] += np.bincount(code.ravel(), parts[c], total_cells)[:total_cells] if total_cells < 4 * code.size else 0
                    if total_cells >= 4 * code.size:
                        u, inverse = np.unique(code.ravel(), return_inverse=True)
                        for c in range(stats):
                            dense[c][u] += np.bincount(inverse, parts[c], len(u))
                else:
                    held.append(_summed(code.ravel(), np.stack(parts)))
                    size += len(held[-1][0])
            if size > DENSE_CELLS:
                held = [_summed(np.concatenate([c for c, _ in held]), np.concatenate([v for _, v in held], axis=1))]
                size = len(held[0][0])
                if size > DENSE_CELLS // 2:
                    yield from _emitted(*held[0], offset, cell)
                    held, size = [], 0
        if dense is not None:
            code = np.flatnonzero(dense.any(0))
            yield from _emitted(code, dense[:, code], offset, cell)
        elif held:
            yield from _emitted(*_summed(np.concatenate([c for c, _ in held]), np.concatenate([v for _, v in held], axis=1)), offset, cell)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are in order of (tree, node): a node's parts follow each other
        at_once = max(1, min(512, DENSE_CELLS // (cell * stats)))
        nodes: list[tuple[int, int]] = []
        hist = np.zeros((at_once, cell, stats))

        def chosen() -> pa.RecordBatch:
            whole = hist[: len(nodes)].reshape(len(nodes), candidates, width, stats)
            f, b, gain, left, right = _best(whole, np.stack([tries[t][n] for t, n in nodes]), most, model.classes)
            return pa.record_batch({
                "tree": pa.array([t for t, _ in nodes], pa.int32()), "node": pa.array([int(open_[t][n]) for t, n in nodes], pa.int32()),
                "feature": pa.array(f.astype(np.int32)), "cut": pa.array(b.astype(np.int32)), "gain": pa.array(gain),
                "total": pa.array(whole[:, 0].sum(1).tolist(), pa.list_(pa.float64())), "left": pa.array(left.tolist(), pa.list_(pa.float64())),
                "right": pa.array(right.tolist(), pa.list_(pa.float64()))
            })

        for b in batches:
            for t, node, codes, values in zip(*(b.column(c).to_pylist() for c in ("tree", "node", "codes", "sums"))):
                if not nodes or nodes[-1] != (t, node):
                    if len(nodes) == at_once:
                        yield chosen()
                        nodes, hist = [], np.zeros((at_once, cell, stats))
                    nodes.append((t, node))
                hist[len(nodes) - 1][np.frombuffer(codes, "<u4")] += np.frombuffer(values, "<f8").reshape(stats, -1).T
        if nodes:
            yield chosen()

    parts = data.mapInArrow(sums, "tree int, node int, codes binary, sums binary").repartition("tree", "node").sortWithinPartitions("tree", "node")
    out = "tree int, node int, feature int, cut int, gain double, total array<double>, left array<double>, right array<double>"
    return sorted(parts.mapInArrow(best, out).collect(), key=lambda r: (r["tree"], r["node"]))  # at most trees x open nodes


def _summed(code: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(code, return_inverse=True)
    return u, np.stack([np.bincount(inverse, v, len(u)) for v in values])


def _emitted(code: np.ndarray, values: np.ndarray, offset: np.ndarray, cell: int) -> Iterator[pa.RecordBatch]:
    """A record per open node: its filled cells and their sums."""
    node = code // cell
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(code) else np.zeros(0, int)
    ends = np.append(starts[1:], len(code))
    number = node[starts] if len(code) else starts
    tree = np.searchsorted(offset, number, "right") - 1
    for a in range(0, len(starts), 2000):
        at = range(a, min(a + 2000, len(starts)))
        yield pa.record_batch({
            "tree": pa.array([int(tree[i]) for i in at], pa.int32()), "node": pa.array([int(number[i] - offset[tree[i]]) for i in at], pa.int32()),
            "codes": pa.array([(code[starts[i] : ends[i]] % cell).astype("<u4").tobytes() for i in at], pa.binary()),
            "sums": pa.array([values[:, starts[i] : ends[i]].astype("<f8").tobytes() for i in at], pa.binary())
        })


def importances(model: Forest) -> np.ndarray:
    """Refits x features: impurity decrease, a tree's summing to 1, averaged over the trees of a refit."""
    out = np.zeros((len(model.grown), len(model.names)))
    for i, t in enumerate(model.grown):
        drop = _impurity(np.stack(t.stats), model.classes)
        for node, f in enumerate(t.feature):
            if f >= 0:
                out[i, f] += drop[node] - drop[t.left[node]] - drop[t.left[node] + 1]
    total = out.sum(1, keepdims=True)
    out = np.divide(out, total, out=np.zeros_like(out), where=total > 0)
    return out.reshape(model.refits, model.trees, -1).mean(1)


def _leaf_values(model: Forest) -> list[np.ndarray]:
    return [np.stack([model.value(s) for s in t.stats]) for t in model.grown]


def held_out_scores(model: Forest, data: DataFrame) -> DataFrame:
    """Rows (refit, score, n): accuracy or R squared over what a refit has not seen.

    Kind ``one``: each copy is predicted by the trees it is out of the bag of (a copy that
    all trees have is left out). Kind ``folds``: each copy by the refit that left its fold out.
    """
    k, count = len(model.names), len(model.grown)
    depth = 64
    columns = "refit int, n double, hits double, y double, yy double, rest double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, values = [t.arrays() for t in model.grown], _leaf_values(model)
        total = np.zeros((model.refits, 5))
        for bins, label, key, n, skip in _pieces(batches, k, count):
            at = _nodes(arrays, bins, depth)
            each = np.stack([values[t][at[:, t]] for t in range(count)], axis=1)  # rows x trees x values
            row, keys, copy = _copies(key, n, skip)
            if model.kind == "folds":
                fold = model.folds(keys, copy)
                use = (np.arange(count)[None, :] // model.trees) == fold[:, None]
            else:
                fold, use = np.zeros(len(row), int), model.weights(keys, copy) == 0
            seen = use.any(1)
            row, use, fold = row[seen], use[seen], fold[seen]
            mean = np.einsum("ct,ctv->cv", use.astype(float), each[row]) / use.sum(1)[:, None]
            y = label[row]
            if model.classes:
                parts = [np.ones(len(y)), mean.argmax(1) == y, y, y * y, np.zeros(len(y))]
            else:
                parts = [np.ones(len(y)), np.zeros(len(y)), y, y * y, (y - mean[:, 0]) ** 2]
            total += np.stack([np.bincount(fold, p, model.refits) for p in parts], axis=1)
        yield pa.record_batch([pa.array(range(model.refits), pa.int32()), *(pa.array(total[:, c]) for c in range(5))], ["refit", "n", "hits", "y", "yy", "rest"])

    s = data.mapInArrow(scored, columns).groupBy("refit").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "y", "yy", "rest")))
    hits = F.try_divide(F.col("hits"), F.col("n"))
    spread = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), F.col("n"))
    score = hits if model.classes else 1 - F.try_divide(F.col("rest"), spread)
    return s.select("refit", score.alias("score"), F.col("n").cast("long").alias("n"))


def predict(model: Forest, x: np.ndarray) -> np.ndarray:
    """Rows x values: the mean over all trees."""
    at, values = _nodes([t.arrays() for t in model.grown], model.bins(x), 64), _leaf_values(model)
    return sum(values[t][at[:, t]] for t in range(len(values))) / len(values)


# --- Shapley values --------------------------------------------------------------------------


@dataclass
class Leaf:
    features: list[int]
    low: np.ndarray  # passes if low < bin <= high
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def leaves(model: Forest, tree: int) -> Iterator[Leaf]:
    """The root-to-leaf paths, a feature's cuts merged to one interval and one share of cover."""
    t = model.grown[tree]
    open_ = [(0, {})]
    while open_:
        node, path = open_.pop()
        f = t.feature[node]
        if f < 0:
            names = sorted(path)
            low, high, share = (np.array([path[j][c] for j in names]) for c in range(3))
            yield Leaf(names, low, high, share, model.value(t.stats[node]))
            continue
        low, high, share = path.get(f, (-1, 256, 1.0))
        whole = model.cover(t.stats[t.left[node]]) + model.cover(t.stats[t.left[node] + 1])
        for side, (a, b) in enumerate(((low, min(high, t.cut[node])), (max(low, t.cut[node]), high))):
            child = t.left[node] + side
            open_.append((child, path | {f: (a, b, share * model.cover(t.stats[child]) / whole)}))


@dataclass
class Leaves:
    """The leaves of all trees that ask for the same features."""

    features: list[int]
    low: np.ndarray  # leaves x features: passes if bin - low < span, in bytes that wrap around
    span: np.ndarray
    share: np.ndarray
    value: np.ndarray


def grouped(model: Forest) -> tuple[np.ndarray, list[Leaves]]:
    """Base values, and all leaves by the features on their paths."""
    base, by = np.zeros(model.classes or 1), {}
    for t in range(len(model.grown)):
        for leaf in leaves(model, t):
            base += leaf.value * leaf.share.prod()
            if leaf.features:
                by.setdefault(tuple(leaf.features), []).append(leaf)
    out = []
    for features, found in by.items():
        low, high, share, value = (np.stack([getattr(leaf, c) for leaf in found]) for c in ("low", "high", "share", "value"))
        out.append(Leaves(list(features), (low + 1).astype(np.uint8), np.maximum(np.minimum(high, 255) - low, 0).astype(np.uint8), share, value))
    return base / len(model.grown), out


def _tables(share: np.ndarray, value: np.ndarray, couples: list[tuple[int, int]]) -> np.ndarray:
    """Leaves x flag patterns x (features, then couples, each by outputs): what a row of that pattern adds."""
    m = share.shape[1]
    nodes, weights = np.polynomial.legendre.leggauss(max(1, (m + 1) // 2))
    s, w = (nodes + 1) / 2, weights / 2
    flags = (np.arange(1 << m)[:, None] >> np.arange(m)[None, :]) & 1
    terms = share[:, None, :, None] * (1 - s) + flags[None, :, :, None] * s  # leaves x patterns x features x nodes
    apart = flags[None] - share[:, None, :]
    out = [apart[..., i] * (np.delete(terms, i, axis=2).prod(2) @ w) for i in range(m)]
    out += [apart[..., i] * apart[..., j] * (np.delete(terms, (i, j), axis=2).prod(2) @ w) / 2 for i, j in couples]
    return (np.stack(out, axis=2)[..., None] * value[:, None, None, :]).reshape(len(share), 1 << m, -1)


def explain(
    model: Forest, bins: np.ndarray, pairs: bool = False, by: tuple[np.ndarray, list[Leaves]] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Base values, Shapley values (rows x features x values) and, if asked, interactions (rows x features x features x values).

    ``by``: what :func:`grouped` gave, if it is there already. Tables are made for many leaves of one kind at a time.
    """
    k, v, n = len(model.names), model.classes or 1, len(model.grown)
    base, groups = by or grouped(model)
    phi = np.zeros((len(bins), k, v))
    both = np.zeros((len(bins), k, k, v)) if pairs else None
    columns = np.ascontiguousarray(bins.T.astype(np.uint8))
    for g in groups:
        m = len(g.features)
        couples = list(combinations(range(m), 2)) if pairs else []
        total = np.zeros((len(bins), (m + len(couples)) * v))
        found = np.empty_like(total)
        kind = np.uint8 if m <= 8 else np.uint16 if m <= 16 else np.uint32
        size = max(1, TABLE_CELLS // ((1 << m) * (m * (m + 1) // 2 + (m + len(couples)) * v)))
        for at in range(0, len(g.share), size):
            tables = _tables(g.share[at : at + size], g.value[at : at + size], couples)
            for table, low, span in zip(tables, g.low[at : at + size], g.span[at : at + size]):
                code = np.zeros(len(bins), kind)
                for i, f in enumerate(g.features):
                    code |= (columns[f] - low[i] < span[i]).astype(kind) << kind(i)
                np.take(table, code, axis=0, out=found, mode="clip")
                total += found
        each = total.reshape(len(bins), m + len(couples), v) / n
        for i, f in enumerate(g.features):
            phi[:, f] += each[:, i]
        for c, (i, j) in enumerate(couples):
            a, b = g.features[i], g.features[j]
            both[:, a, b] += each[:, m + c]
            both[:, b, a] += each[:, m + c]
    if pairs:
        every = np.arange(k)
        both[:, every, every] = phi - both.sum(2)
    return base, phi, both


def shapley_values(model: Forest, matrix: DataFrame) -> DataFrame:
    """Rows (x, base, values, prediction) of a matrix's rows: arrays over the outputs, and over features and outputs."""
    from pyspark.ml.functions import vector_to_array

    k = len(model.names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = grouped(model)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), k)
                base, phi, _ = explain(model, model.bins(x), by=by)
                yield pa.record_batch({
                    "x": b.column(0), "base": pa.array([base.tolist()] * len(x)), "values": pa.array(phi.tolist()), "prediction": pa.array(predict(model, x).tolist())
                })

    return matrix.select(vector_to_array("features").alias("x")).mapInArrow(made, "x array<double>, base array<double>, values array<array<double>>, prediction array<double>")


def equal_rows(data: DataFrame) -> DataFrame:
    """Rows (bins, n), dealt over tasks by their number: few bytes, but much work a row, so that Spark would put all in one task."""
    tasks = max(1, -(-data.select("bins").distinct().count() // EXPLAINED_ROWS))
    return data.groupBy("bins").agg(F.sum("n").alias("n")).repartition(tasks, "bins")


def _mean_abs(model: Forest, data: DataFrame, pairs: bool) -> DataFrame:
    """Rows (a, b, strength) over all copies of binned rows: means of absolute values, outputs averaged; b = -1 for Shapley values."""
    k = len(model.names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, by = np.zeros((k, k + 1)), 0.0, grouped(model)
        for b in batches:
            for at in range(0, b.num_rows, EXPLAINED_ROWS):
                part = b.slice(at, EXPLAINED_ROWS)
                bins = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, k)
                w = part.column(1).to_numpy().astype(float)
                _, phi, both = explain(model, bins, pairs, by)
                total[:, k] += np.einsum("r,rfv->f", w, np.abs(phi)) / phi.shape[2]
                if pairs:
                    total[:, :k] += np.einsum("r,rfgv->fg", w, np.abs(both)) / both.shape[3]
                n += w.sum()
        a, b = np.divmod(np.arange(k * (k + 1)), k + 1)
        keep = (b == k) | pairs
        flat = total.ravel()[keep]
        yield pa.record_batch([pa.array(a[keep].astype(np.int32)), pa.array(np.where(b[keep] == k, -1, b[keep]).astype(np.int32)), pa.array(flat), pa.array(np.full(len(flat), n))], ["a", "b", "s", "n"])

    return equal_rows(data).mapInArrow(made, "a int, b int, s double, n double").groupBy("a", "b").agg((F.sum("s") / F.sum("n")).alias("strength"))


def mean_abs_shapley(model: Forest, data: DataFrame) -> DataFrame:
    """Rows (feature, importance)."""
    labels = F.array(*map(F.lit, model.names))
    return _mean_abs(model, data, False).select(F.element_at(labels, F.col("a") + 1).alias("feature"), F.col("strength").alias("importance"))


def interactions(model: Forest, data: DataFrame, features: list[str]) -> DataFrame:
    """Rows (feature_a, feature_b, strength, a_alone, b_alone, combined) for pairs of the named features."""
    found = _mean_abs(model, data, True)
    index = [model.names.index(f) for f in features]
    order = F.array(*map(F.lit, index))
    # at most features squared rows, in one row: the explaining job is not run again for each side of a pair
    one = found.agg(
        F.collect_list(F.struct("a", "b", "strength")).alias("all"), F.map_from_entries(F.collect_list(F.when(F.col("a") == F.col("b"), F.struct("a", "strength")))).alias("alone")
    )
    pairs = one.select("alone", F.explode("all").alias("p")).select("alone", "p.*")
    pairs = pairs.filter((F.col("b") >= 0) & (F.col("a") != F.col("b")) & F.col("a").isin(index) & F.col("b").isin(index))
    pairs = pairs.filter(F.array_position(order, F.col("a")) < F.array_position(order, F.col("b")))
    both = pairs.withColumns({"a_alone": F.col("alone")[F.col("a")], "b_alone": F.col("alone")[F.col("b")]})
    labels = F.array(*map(F.lit, model.names))
    return both.select(
        F.element_at(labels, F.col("a") + 1).alias("feature_a"), F.element_at(labels, F.col("b") + 1).alias("feature_b"), "strength", "a_alone", "b_alone",
        (F.col("strength") + F.col("a_alone") + F.col("b_alone")).alias("combined")
    )


def stability(model: Forest, matrix: DataFrame) -> DataFrame:
    """Rows (feature, mean, std, cv, stability) of the importances over the refits."""
    per = importances(model)
    mean, std = per.mean(0), per.std(0)
    cv = np.divide(std, mean, out=np.zeros_like(std), where=mean > 0)
    made = [(f, float(m), float(s), float(c), float(1 - c / (c + 1))) for f, m, s, c in zip(model.names, mean, std, cv)]
    return matrix.sparkSession.createDataFrame(made, "feature string, mean double, std double, cv double, stability double")
