"""Outliers: fences, z-scores, isolation forest, density noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import name, numeric_columns, share
from tidewell.operators.profile import one_row_per_column
from tidewell.operators.ranks import column_quantiles


def fences(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (column_name, n, outliers, pct, lower, upper) by 1.5 IQR, two passes for all columns."""
    columns = columns or numeric_columns(df)
    q = column_quantiles(df, columns, [0.25, 0.75])
    q = q.select(
        "column_name", (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("lower"),
        (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("upper")
    )
    return _flagged(df, columns, q, lambda x: (x < F.col("lower")) | (x > F.col("upper")), ["lower", "upper"])


def z_scores(df: DataFrame, columns: list[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Rows (column_name, n, outliers, pct, mean, std): |z| above the limit, z by the population deviation."""
    columns = columns or numeric_columns(df)
    made = {"mean": F.avg, "std": F.stddev_samp, "sd": F.stddev_pop}
    s = one_row_per_column(df, columns, {k: (lambda c, f=f: f(name(c).cast("double"))) for k, f in made.items()})
    return _flagged(df, columns, s, lambda x: F.abs(x - F.col("mean")) > limit * F.col("sd"), ["mean", "std"])


def _flagged(df: DataFrame, columns: list[str], stats: DataFrame, outside, show: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*(F.struct(
        F.lit(c).alias("column_name"), name(c).cast("double").alias("x")
    ) for c in columns))).alias("i")).select("i.*").filter("x IS NOT NULL")
    out = long.join(F.broadcast(stats), "column_name").groupBy("column_name", *show).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outside(F.col("x"))).alias("outliers")
    )
    return out.select("column_name", "n", "outliers", share(F.col("outliers"), F.col("n")).alias("pct"), *show)


def outlier_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return fences(df, columns).orderBy(F.col("pct").desc(), "column_name")


def outlier_rows(df: DataFrame, columns: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows outside any fence (at most ``limit``), and their number."""
    columns = columns or numeric_columns(df)
    q = column_quantiles(df, columns, [0.25, 0.75])
    one = q.agg(*(F.max(F.when(F.col("column_name") == c, F.col("q"))).alias(f"__q{i}") for i, c in enumerate(columns)))
    joined = df.crossJoin(F.broadcast(one))
    bad = F.lit(False)
    for i, c in enumerate(columns):
        lo, hi = F.col(f"__q{i}")[0], F.col(f"__q{i}")[1]
        bad = bad | F.coalesce((name(c) < lo - 1.5 * (hi - lo)) | (name(c) > hi + 1.5 * (hi - lo)), F.lit(False))
    found = joined.filter(bad).select(*(name(c) for c in df.columns))
    return found.limit(limit), found.agg(F.count(F.lit(1)).alias("outlier_rows"))


def isolation_forest(
    df: DataFrame, columns: list[str], keys: list[str], trees: int = 100, size: int = 256, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """Rows (keys, score, outlier): trees grown in parallel on hash subsamples, scores in one pass.

    A tree needs ``size`` rows whatever the table holds, so the forest that is
    broadcast has a fixed bound of about 2 * trees * size nodes.
    """
    rows = df.select(*(name(k) for k in keys), *(name(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).dropna()
    k = len(columns)
    total = rows.agg(F.count(F.lit(1)).alias("__t"))
    # the trees of a row are drawn in its own array, so that most rows make no row at all
    drawn_by = lambda t: F.pmod(F.xxhash64(*keys, t, F.lit(seed)), F.lit(1 << 40)) * F.col("__t").cast("double") <= F.lit(float(1 << 40)) * size * 1.5
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), drawn_by)
    drawn = rows.crossJoin(F.broadcast(total)).withColumn("tree", F.explode(mine)).drop("__t")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        x = pdf.sort_values([f"c{i}" for i in range(k)])[[f"c{i}" for i in range(k)]].to_numpy()
        x = x[rng.permutation(len(x))[:size]]
        deepest, nodes = int(np.ceil(np.log2(max(2, len(x))))), []

        def split(part: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([key[0], me, -1, 0.0, -1, -1, depth + _mean_path(len(part))])
            spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(k)
            if depth < deepest and len(part) > 1 and spread.any():
                f = int(rng.choice(np.flatnonzero(spread > 0)))
                cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                left, right = split(part[part[:, f] < cut], depth + 1), split(part[part[:, f] >= cut], depth + 1)
                nodes[me][2:6] = [f, cut, left, right]
            return me

        split(x, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "path"])

    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, low int, high int, path double").toPandas()
    # all trees in one table; a leaf leads to itself
    forest = forest.sort_values(["tree", "node"], ignore_index=True)
    roots = np.flatnonzero(forest["node"].to_numpy() == 0)
    offset = np.repeat(roots, np.diff(np.append(roots, len(forest))))
    leaf, own = forest["feature"].to_numpy() < 0, np.arange(len(forest))
    low, high = (np.where(leaf, own, forest[c].to_numpy() + offset) for c in ("low", "high"))
    steps = int(np.ceil(np.log2(max(2, size))))
    nodes = (np.maximum(forest["feature"].to_numpy(), 0), forest["cut"].to_numpy(float), np.stack([high, low], 1).ravel(), forest["path"].to_numpy(float))
    tables = _tables(forest, nodes, roots, steps, k)
    shared = df.sparkSession.sparkContext.broadcast((nodes, roots, *tables))
    norm = max(_mean_path(size), 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, roots, edges, looked_up = shared.value
        walked = np.array([t for t in range(len(roots)) if t not in looked_up], int)
        for b in batches:
            x = b[[f"c{i}" for i in range(k)]].to_numpy()
            found = np.zeros(len(x))
            for a in range(0, len(x), 2048):
                part = x[a : a + 2048]
                place = [np.searchsorted(e, part[:, j], "right") for j, e in enumerate(edges)]
                paths = np.zeros((len(part), len(roots)))
                for t, (steps_of, table) in looked_up.items():
                    paths[:, t] = table.take(sum(s.take(p) for s, p in zip(steps_of, place)))
                if len(walked):
                    paths[:, walked] = _walk(part, nodes, roots[walked], steps)
                found[a : a + 2048] = paths.mean(1) if len(roots) else 0.0
            b["score"] = 2.0 ** (-found / norm)
            yield b[[*keys, "score"]]

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    scored = rows.mapInPandas(score, f"{kinds}, score double")
    limit = scored.agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("__limit"))
    return scored.crossJoin(F.broadcast(limit)).select(*keys, "score", (F.col("score") > F.col("__limit")).alias("outlier"))


#: Cells of a tree's table; trees with more are walked.
TREE_CELLS = 1 << 15


def _walk(x: np.ndarray, nodes: tuple[np.ndarray, ...], roots: np.ndarray, steps: int) -> np.ndarray:
    """Rows x trees: the path lengths, from node to node."""
    feature, cut, both, path = nodes
    flat, first, at = x.ravel(), np.arange(len(x))[:, None] * x.shape[1], np.repeat(roots[None, :], len(x), 0)
    for _ in range(steps):
        at = both.take(2 * at + (flat.take(feature.take(at) + first) < cut.take(at)))
    return path.take(at)


def _tables(forest: pd.DataFrame, nodes: tuple[np.ndarray, ...], roots: np.ndarray, steps: int, k: int) -> tuple[list[np.ndarray], dict]:
    """The cuts of all trees per feature, and per tree the path length in each cell of the grid of its own cuts.

    A tree's table comes with one array per feature that leads from a place among all cuts to
    the cell; trees whose grid is larger than ``TREE_CELLS`` (three features or more) have none.
    """
    inner = forest[forest["feature"] >= 0]
    edges = [np.unique(inner.loc[inner["feature"] == j, "cut"].to_numpy(float)) for j in range(k)]
    out = {}
    for t, tree in enumerate(forest["tree"].unique()):
        mine = inner[inner["tree"] == tree]
        cuts = [np.unique(mine.loc[mine["feature"] == j, "cut"].to_numpy(float)) for j in range(k)]
        shape = [len(c) + 1 for c in cuts]
        if np.prod(shape, dtype=float) > TREE_CELLS:
            continue
        # a cell holds its lower edges
        grid = np.stack(np.meshgrid(*(np.append(-np.inf, c) for c in cuts), indexing="ij"), -1).reshape(-1, k)
        strides = np.cumprod([1, *shape[:0:-1]])[::-1]
        steps_of = [(np.searchsorted(c, np.append(-np.inf, e), "right") * s).astype(np.int32) for c, e, s in zip(cuts, edges, strides)]
        out[t] = steps_of, _walk(grid, nodes, roots[t : t + 1], steps)[:, 0]
    return edges, out


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


#: Distinct points of a cell beyond which its points stay where they are and what is asked of them is sent there.
HEAVY_CELL, MOST_ASKED = 10_000, 2_000_000


#: Points of a block whose neighbours are counted at once, and distances held at a time.
BLOCK_POINTS, MOST_DISTANCES = 5000, 1 << 18


def neighbour_counts(points: DataFrame, k: int, eps: float) -> DataFrame:
    """Rows (z, neighbours): the weight ``n`` of all points within ``eps`` of each distinct point ``z``, itself included.

    Wide cells over the first three columns are cut into blocks of ``BLOCK_POINTS`` points. Pairs of
    blocks that lie within ``eps`` as a whole, by their boxes, add a total; only pairs across the
    edge are compared, a pair of blocks at a time.
    """
    g = min(k, 3)
    wide = lambda v: F.floor(v / eps).cast("long")
    placed = points.withColumn("w", F.array(*(wide(F.col("z")[i]) for i in range(g))))
    placed = placed.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("w").orderBy("z")) - 1) / BLOCK_POINTS))
    side = lambda f: F.array(*(f(F.col("z")[i]) for i in range(k)))
    blocks = placed.groupBy("w", "part").agg(
        F.collect_list("z").alias("zs"), F.collect_list("n").alias("ns"), F.sum("n").alias("total"), side(F.min).alias("low"), side(F.max).alias("high")
    )
    mine = blocks.select(F.col("w").alias("aw"), F.col("part").alias("apart"), F.col("low").alias("alow"), F.col("high").alias("ahigh"))
    near = mine
    for i in range(g):
        near = near.withColumn(f"o{i}", F.explode(F.array(*(F.col("aw")[i] + o for o in (-1, 0, 1)))))
    near = near.withColumn("w", F.array(*(f"o{i}" for i in range(g)))).drop(*(f"o{i}" for i in range(g)))
    near = near.join(blocks.select("w", "part", "low", "high", "total"), "w")
    square = lambda x, y, f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda a, v: a + v * v)
    spans = F.zip_with("alow", "high", lambda a, b: b - a), F.zip_with("low", "ahigh", lambda a, b: b - a)
    gaps = F.zip_with("ahigh", "low", lambda a, b: b - a), F.zip_with("high", "alow", lambda a, b: b - a)
    near = near.withColumns({"far": square(*spans, lambda a, b: F.greatest(a, b)), "gap": square(*gaps, lambda a, b: F.greatest(a, b, F.lit(0.0)))})
    near = near.filter(F.col("gap") <= eps * eps)
    whole = near.filter(F.col("far") <= eps * eps).groupBy("aw", "apart").agg(F.sum("total").alias("neighbours"))
    whole = whole.join(placed.select(F.col("w").alias("aw"), F.col("part").alias("apart"), "z"), ["aw", "apart"]).select("z", "neighbours")
    partly = near.filter(F.col("far") > eps * eps).select("aw", "apart", "w", "part")
    asking = blocks.select(F.col("w").alias("aw"), F.col("part").alias("apart"), F.col("zs").alias("asking"))
    partly = partly.join(asking, ["aw", "apart"]).join(blocks.select("w", "part", "zs", "ns"), ["w", "part"]).select("asking", "zs", "ns")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = batch.column(0)[i].values
                a, b = (c.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in (asked, batch.column(1)[i].values))
                n, found = batch.column(2)[i].values.to_numpy(), np.zeros(len(a), np.int64)
                step = max(1, MOST_DISTANCES // len(b))
                for at in range(0, len(a), step):
                    d = np.zeros((len(a[at : at + step]), len(b)))
                    for j in range(k):
                        gap = a[at : at + step, j, None] - b[None, :, j]
                        d += gap * gap
                    found[at : at + step] = (d <= eps * eps) @ n
                yield pa.RecordBatch.from_arrays([asked, pa.array(found)], ["z", "neighbours"])

    spark = points.sparkSession
    compared = partly.repartition(max(32, spark.sparkContext.defaultParallelism * 4)).mapInArrow(compare, "z array<double>, neighbours long")
    return whole.unionByName(compared).groupBy("z").agg(F.sum("neighbours").alias("neighbours"))


def density_noise(df: DataFrame, columns: list[str], key: str, eps: float = 0.5, least: int = 5, counts: bool = False) -> DataFrame:
    """Rows (key, core, noise): points with ``least`` points (itself counted) within ``eps``, and those that no such point is near.

    With ``counts`` there is a column ``neighbours``: how many points are within ``eps``, itself counted.

    Columns are standardised; equal points are one with their number. Points fall into cells
    so narrow that all points of a cell are within ``eps`` of each other: a cell with ``least``
    points is core as a whole, without a comparison. Only points of thinner cells look
    around, and at whole cells first: by its bounding box a cell counts entirely, not at all, or
    is looked into. So a crowd in one cell costs its reading, and nothing in pairs.
    """
    k = len(columns)
    stats = df.agg(*(F.avg(name(c)).alias(f"__m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(name(c)).alias(f"__s{i}") for i, c in enumerate(columns)))
    z = [F.coalesce(F.try_divide(name(c) - F.col(f"__m{i}"), F.col(f"__s{i}")), F.lit(0.0)) for i, c in enumerate(columns)]
    rows = df.dropna(subset=columns).crossJoin(F.broadcast(stats)).select(name(key).alias("key"), F.array(*z).alias("z"))
    fine = F.transform("z", lambda v: F.floor(v / (eps / k**0.5)).cast("long"))
    # neighbours are looked up by wide cells over the first columns
    g = min(k, 3)
    wide = lambda v: F.floor(v / eps).cast("long")
    points = rows.groupBy("z").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", fine)
    side = lambda f: F.array(*(f(F.col("z")[i]) for i in range(k)))
    cells = points.groupBy("cell").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("points"), side(F.min).alias("low"), side(F.max).alias("high"))
    square = lambda arrays, f: F.aggregate(F.zip_with(*arrays, f), F.lit(0.0), lambda a, v: a + v * v)
    cells = cells.withColumn("dense", (F.col("total") >= least) & (square(("low", "high"), lambda a, b: b - a) <= eps * eps))

    thin = points.join(cells.filter("NOT dense").select("cell"), "cell").select("z", "n")
    asking = thin
    for i in range(g):
        asking = asking.withColumn(f"w{i}", F.explode(F.array(*(wide(F.col("z")[i]) + o for o in (-1, 0, 1)))))
    ids = [f"w{i}" for i in range(g)]
    # a narrow cell can lie over the edge of a wide one: it is listed by all the wide cells its box touches
    listed = cells
    for i in range(g):
        listed = listed.withColumn(f"w{i}", F.explode(F.array_distinct(F.array(wide(F.col("low")[i]), wide(F.col("high")[i])))))
    far = square((F.zip_with("z", "low", lambda v, a: F.abs(v - a)), F.zip_with("z", "high", lambda v, b: F.abs(v - b))), lambda a, b: F.greatest(a, b))
    near = square((F.zip_with("z", "low", lambda v, a: a - v), F.zip_with("z", "high", lambda v, b: v - b)), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    seen = asking.join(listed, ids).withColumns({"far": far, "near": near}).filter(F.col("near") <= eps * eps).dropDuplicates(["z", "cell"])
    seen = seen.select("z", "cell", "total", "points", "dense", (F.col("far") <= eps * eps).alias("whole"))

    # looked into: pairs of an asking point and a point of the cell
    into = seen.filter("NOT whole").select(F.col("z").alias("a"), "cell", "dense")
    heavy = cells.filter(F.col("points") > HEAVY_CELL).select("cell")
    asked = into.join(heavy, "cell", "left_semi")
    few = asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED
    distance = square((F.col("a"), F.col("z")), lambda u, v: u - v)
    if few:
        light = into.join(heavy, "cell", "left_anti").join(points, "cell")
        pairs = light.unionByName(points.join(F.broadcast(asked), "cell").select(*light.columns))
    else:
        pairs = into.join(points, "cell")
    pairs = pairs.filter(distance <= eps * eps).select("a", "z", "n", "dense")

    found = seen.filter("whole").select(F.col("z").alias("a"), F.col("total").alias("n")).unionByName(pairs.select("a", "n"))
    core_thin = found.groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("z"))
    # near a core point: of a dense cell, or a thin one
    core_cells = core_thin.withColumn("cell", fine).select("cell").distinct()
    by_cell = seen.filter("whole AND dense").select("z").unionByName(seen.filter("whole AND NOT dense").join(core_cells, "cell", "left_semi").select("z"))
    by_pair = pairs.filter("dense").select(F.col("a").alias("z")).unionByName(pairs.filter("NOT dense").join(core_thin, "z", "left_semi").select(F.col("a").alias("z")))
    reached = by_cell.unionByName(by_pair).distinct()

    flags = thin.select("z").join(core_thin.withColumn("core", F.lit(True)), "z", "left").join(reached.withColumn("reached", F.lit(True)), "z", "left")
    flags = flags.select("z", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("core", "reached", F.lit(False)).alias("held"))
    # points of dense cells are not in ``flags``; a crowd of one point is one row of it at most
    more = []
    if counts:
        flags, more = neighbour_counts(points.select("z", "n"), k, eps).join(flags, "z", "left"), ["neighbours"]
    out = rows.join(flags, "z", "left")
    return out.select(F.col("key").alias(key), *more, F.coalesce("core", F.lit(True)).alias("core"), F.coalesce(~F.col("held"), F.lit(False)).alias("noise"))
