"""Series longer than a task: blocks of consecutive points, each a group of its own.

Three patterns carry all operators here:

* *halo*: a point goes to its own block and to each later block that looks back to it;
* *merge in a tree*: a block's regression is a small triangular factor, ``FAN`` factors are
  stacked and reduced to one, until one is left; sums are merged as sums;
* *scan*: a block leaves a one-row summary, a prefix over the summaries of a series (as many
  rows as blocks) gives what enters each block, and the block's rows take it in.

No group holds a series. Results are those of the whole series up to rounding, whatever the size
of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.dist import chi2_upper

#: Points of a block, and factors merged at a time.
SIZE, FAN = 100_000, 64


def kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def numbered(s: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, i, pos, value, ...) of the known values, ``i`` from 0 without gaps."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return s.filter("value IS NOT NULL").withColumn("i", (F.row_number().over(w) - 1).cast("long"))


def lengths(x: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: n, mean, sd, low, high of the values."""
    v = F.col("value")
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def with_halo(x: DataFrame, reach: Column, size: int, at: str = "i") -> DataFrame:
    """Each point once per block that needs it: its own, and those that begin up to ``reach`` points later."""
    here = F.floor(F.col(at) / size)
    return x.withColumn("block", F.explode(F.sequence(here, F.floor((F.col(at) + reach) / size)))).withColumn("first", F.col("block") * size)


def per_block(x: DataFrame, keys: list[str], f: Callable[[pd.DataFrame, int], list[tuple]], schema: str, at: str = "i") -> DataFrame:
    """``f(points in order, place of the block's own first point)`` per block; rows (keys, block, schema)."""
    fields = [c.strip().split()[0] for c in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, ignore_index=True)
        own = int(np.searchsorted(pdf[at].to_numpy(), int(pdf["first"].iloc[0])))
        found = f(pdf, own) if own < len(pdf) else []
        return pd.DataFrame([(*key, *r) for r in found], columns=[*keys, "block", *fields])

    return x.groupBy(*keys, "block").applyInPandas(run, f"{kinds(x, keys)}block long, {schema}")


def per_key(x: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], list[tuple]], schema: str, order: str = "block") -> DataFrame:
    """``f(a series' few block rows in order)``."""
    fields = [c.strip().split()[0] for c in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in f(pdf.sort_values(order, ignore_index=True))], columns=[*keys, *fields])

    return x.groupBy(*keys).applyInPandas(run, f"{kinds(x, keys)}{schema}")


def blocks_of(x: DataFrame, keys: list[str], size: int) -> int:
    """Blocks of the longest series."""
    longest = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return -(-int(longest or 0) // size)


# --- regressions --------------------------------------------------------------------------------


def factor(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.qr(matrix, mode="r")


def factor_in_pieces(rows: Callable[[int, int], np.ndarray], first: int, end: int, width: int) -> np.ndarray:
    """Triangular factor of the matrix whose rows a..b are rows(a, b), about 4 million cells at a time."""
    r, step = np.zeros((0, width)), max(1024, 4_000_000 // width)
    for a in range(first, end, step):
        r = factor(np.vstack((r, rows(a, min(a + step, end)))))
    return r


def merge_factors(parts: DataFrame, keys: list[str], blocks: int, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (keys, extra, r, rows, head): the stacked factors ``r`` (flat, as wide as ``width``) of each series reduced to one, in a tree."""
    by = [*keys, *extra]
    types = kinds(parts, by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        width = int(pdf["width"].iloc[0])
        stacked = np.vstack([np.asarray(r, float).reshape(-1, width) for r in pdf["r"]])
        head = pdf["head"].iloc[0]
        return pd.DataFrame([(*key, width, factor(stacked).ravel() if len(stacked) else [], int(pdf["rows"].sum()), head)], columns=[*by, "block", "width", "r", "rows", "head"])

    while True:
        parts = parts.withColumn("block", F.floor(F.col("block") / FAN)).groupBy(*by, "block").applyInPandas(
            run, f"{types}block long, width int, r array<double>, rows long, head array<double>"
        )
        blocks = -(-blocks // FAN)
        if blocks <= 1:
            return parts


def ols(r: np.ndarray, columns: list[int], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, standard errors and residual sum of squares from a factor whose last column is explained."""
    x, y = r[:, columns], r[:, -1]
    p = np.linalg.pinv(x)
    b = p @ y
    rss = float(((y - x @ b) ** 2).sum())
    return b, np.sqrt((p * p).sum(axis=1) * rss / max(1, n - len(columns))), rss


def most_lags(n: int) -> int:
    return min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)


def reach() -> Column:
    """The same as a column, and a little more: how far back a row of the unit-root regressions looks."""
    return F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))) + 2


def _lag_rows(v: np.ndarray, top: int, a: int, b: int) -> np.ndarray:
    """Rows t in a..b of (1, v[t-1], differences 1..top before, difference at t)."""
    d = np.diff(v)
    return np.column_stack([np.ones(b - a), v[a - 1 : b - 1], *(d[a - 1 - i : b - 1 - i] for i in range(1, top + 1)), d[a - 1 : b - 1]])


def adf(s: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Per series: unit-root test with constant, lags by AIC; p from a response surface."""
    x = numbered(s, keys)
    long = x.join(lengths(x, keys), keys).filter("n >= 12 AND low < high")

    def block(pdf: pd.DataFrame, own: int) -> list[tuple]:
        v, n, low = pdf["value"].to_numpy(float), int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0])
        top = most_lags(n)
        a = max(own, top + 1 - low)
        r = factor_in_pieces(lambda p, q: _lag_rows(v, top, p, q), a, max(a, len(v)), top + 3)
        head = [float(n), *v[: 2 * top + 3]] if low == 0 and own == 0 else [float(n)]
        return [(top + 3, r.ravel(), max(0, len(v) - a), head)]

    parts = per_block(with_halo(long, reach(), size), keys, block, "width int, r array<double>, rows long, head array<double>")
    merged = merge_factors(parts, keys, blocks_of(x, keys, size))

    def test(pdf: pd.DataFrame) -> list[tuple]:
        width, head = int(pdf["width"].iloc[0]), np.asarray(pdf["head"].iloc[0], float)
        n, v, top = int(head[0]), head[1:], width - 3
        r, m, best = np.asarray(pdf["r"].iloc[0], float).reshape(-1, width), n - 1 - top, None
        for p in range(top + 1):  # all candidates on the same rows, so that criteria compare
            rss = ols(r[:, [*range(p + 2), -1]], list(range(p + 2)), m)[2]
            aic = m * np.log(max(rss, 1e-300) / m) + 2 * (p + 2)
            if best is None or aic < best[0]:
                best = (aic, p)
        p = best[1]
        m = n - 1 - p
        # fewer lags leave more rows: those at the beginning
        rows = np.vstack([r[:, [*range(p + 2), -1]], _lag_rows(v, p, p + 1, top + 1)])
        b, se, _ = ols(factor(rows), list(range(p + 2)), m)
        t = float(b[1] / se[1]) if se[1] > 0 else -np.inf
        phi = NormalDist().cdf
        pv = 1.0 if t > 2.74 else 0.0 if t < -18.83 else phi(2.1659 + 1.4412 * t + 0.038269 * t * t) if t <= -1.61 else phi(1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t**3)
        critical = [
            a + b1 / m + c / m**2 + e / m**3 for a, b1, c, e in ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))
        ]
        return [(t, p, pv, *critical)]

    return per_key(merged, keys, test, "statistic double, lags int, p double, critical_1 double, critical_5 double, critical_10 double")


def kpss(s: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Per series: level stationarity; p between 0.01 and 0.10."""
    x = numbered(s, keys)
    long = x.join(lengths(x, keys), keys).filter("n >= 5 AND low < high")

    def products(e: np.ndarray, own: int, lag: int) -> float:
        a = max(own, lag)
        return float(e[a:] @ e[a - lag : len(e) - lag]) if a < len(e) else 0.0

    def block(pdf: pd.DataFrame, own: int) -> list[tuple]:
        n = int(pdf["n"].iloc[0])
        e = pdf["value"].to_numpy(float) - float(pdf["mean"].iloc[0])
        c = np.cumsum(e[own:])
        return [(n, [products(e, own, i) for i in range(int(n ** (2 / 9)) + 1)], float(c[-1]), float(c.sum()), float(c @ c), len(c))]

    first = F.floor(F.pow("n", F.lit(2 / 9)))
    parts = per_block(with_halo(long, first, size), keys, block, "n long, products array<double>, s double, c double, cc double, own long")

    def lag_of(pdf: pd.DataFrame) -> list[tuple]:
        n, p = int(pdf["n"].iloc[0]), np.stack([np.asarray(v, float) for v in pdf["products"]]).sum(0)
        s0, s1 = p[0] / n, 0.0
        for i in range(1, len(p)):
            s0, s1 = s0 + p[i] / (n / 2), s1 + i * p[i] / (n / 2)
        lag = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
        before, total = 0.0, 0.0
        for s, c, cc, own in zip(*(pdf[k] for k in ("s", "c", "cc", "own"))):
            total += cc + 2 * before * c + own * before * before
            before += s
        return [(n, lag, float(p[0]), total)]

    known = per_key(parts, keys, lag_of, "n long, lag int, ee double, total double")

    def weighted(pdf: pd.DataFrame, own: int) -> list[tuple]:
        lag = int(pdf["lag"].iloc[0])
        e = pdf["value"].to_numpy(float) - float(pdf["mean"].iloc[0])
        return [(sum((1 - i / (lag + 1)) * products(e, own, i) for i in range(1, lag + 1)),)]

    again = long.join(known.select(*keys, "lag"), keys)
    sums = per_block(with_halo(again, F.col("lag"), size), keys, weighted, "w double").groupBy(*keys).agg(F.sum("w").alias("w"))
    stat = F.expr("total / (n * (ee + 2 * w))")

    def p_of(c: Column) -> Column:
        """Linear between the published points."""
        points = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
        out = F.when(c <= points[0][0], points[0][1])
        for (a, pa), (b, pb) in zip(points, points[1:]):
            out = out.when(c <= b, pa + (c - a) * ((pb - pa) / (b - a)))
        return out.otherwise(points[-1][1])

    return known.join(sums, keys).select(*keys, stat.alias("statistic"), "lag").select(*keys, "statistic", F.col("lag").alias("lags"), p_of(F.col("statistic")).alias("p"))


def zivot_andrews(s: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Per series: unit root against one break in level; the break with the smallest t."""
    x = numbered(s, keys)
    long = x.join(lengths(x, keys), keys).filter("n >= 30 AND low < high")
    lags = lambda n: int(np.ceil(12 * (n / 100) ** 0.25)) // 2

    def rows_of(pdf: pd.DataFrame) -> tuple[Callable[[int, int], np.ndarray], int, int, int]:
        n, low = int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0])
        # constant, trend, level and lags in units that keep the factor well conditioned
        v = (pdf["value"].to_numpy(float) - float(pdf["mean"].iloc[0])) / float(pdf["sd"].iloc[0])
        k = lags(n)

        def rows(a: int, b: int) -> np.ndarray:
            m = _lag_rows(v, k, a, b)
            return np.column_stack([m[:, 0], (np.arange(a, b) - 1 + low) / n - 0.5, m[:, 1:]])

        return rows, n, k, low

    def block(pdf: pd.DataFrame, own: int) -> list[tuple]:
        rows, n, k, low = rows_of(pdf)
        a = max(own, k + 1 - low)
        r = factor_in_pieces(rows, a, max(a, len(pdf)), k + 4)
        total = np.zeros(k + 4)
        for p in range(a, len(pdf), 50_000):
            total += rows(p, min(p + 50_000, len(pdf))).sum(0)
        return [(k + 4, r.ravel(), max(0, len(pdf) - a), [float(n)], total.tolist())]

    spread = with_halo(long, reach(), size)
    parts = per_block(spread, keys, block, "width int, r array<double>, rows long, head array<double>, total array<double>")
    merged = merge_factors(parts.drop("total"), keys, blocks_of(x, keys, size)).drop("block")

    def suffix(pdf: pd.DataFrame) -> list[tuple]:
        after, out = np.zeros(len(pdf["total"].iloc[0])), []
        for b, total in zip(pdf["block"][::-1], pdf["total"][::-1]):
            out.append((int(b), after.tolist()))
            after = after + np.asarray(total, float)
        return out

    entering = per_key(parts.select(*keys, "block", "total"), keys, suffix, "block long, after array<double>")

    def breaks(pdf: pd.DataFrame, own: int) -> list[tuple]:
        rows, n, k, low = rows_of(pdf)
        r = np.asarray(pdf["r"].iloc[0], float).reshape(-1, k + 4)
        p = np.linalg.pinv(r[:, :-1])
        inverse, beta = p @ p.T, p @ r[:, -1]
        rss = float(((r[:, -1] - r[:, :-1] @ beta) ** 2).sum())
        dof, best, after = max(1, n - 1 - k - (k + 4)), (np.inf, 0), np.asarray(pdf["after"].iloc[0], float)
        # the break's column joins by its products with the others: sums over the rows from the cut on
        begin = max(own, k + 1 - low)
        for a in reversed(range(begin, len(pdf), 50_000)):
            b = min(a + 50_000, len(pdf))
            v = np.cumsum(rows(a, b)[::-1], axis=0)[::-1] + after
            after, cuts = v[0], np.arange(a, b) - 1 + low
            u = v[:, :-1] @ inverse
            left = n - 1 - cuts - (u * v[:, :-1]).sum(axis=1)
            ok = (cuts >= int(0.15 * n)) & (cuts < int(0.85 * n)) & (left > 1e-9)
            g = (v[:, -1] - v[:, :-1] @ beta)[ok] / left[ok]
            var = np.maximum(rss - left[ok] * g * g, 0) / dof * (inverse[2, 2] + u[ok, 2] ** 2 / left[ok])
            t = np.where(var > 0, (beta[2] - u[ok, 2] * g) / np.sqrt(np.where(var > 0, var, 1)), np.inf)
            if len(t):
                best = min(best, (float(t.min()), int(cuts[ok][t.argmin()])))
        return [best] if np.isfinite(best[0]) else []

    both = spread.join(merged.select(*keys, "r"), keys).join(entering, [*keys, "block"])
    found = per_block(both, keys, breaks, "statistic double, at long").groupBy(*keys).agg(F.min(F.struct("statistic", "at")).alias("b"))
    found = found.select(*keys, "b.statistic", F.col("b.at").alias("i")).join(x.select(*keys, "i", "pos"), [*keys, "i"])
    return found.select(
        *keys, "statistic", F.col("pos").cast("int").alias("break_pos"),
        *(F.lit(v).alias(f"critical_{c}") for c, v in ((1, -5.34), (5, -4.80), (10, -4.58)))
    )


def granger(rows: DataFrame, keys: list[str], others: list[str], size: int = SIZE) -> DataFrame:
    """Rows (other, lags, chi2, p) for a table (keys, pos, value, others) without nulls, ``pos`` from 0: the best of all numbers of lags."""
    width = lambda k: 2 * k + 2
    most = lambda n: max(1, min(12, n // 25))
    pairs = rows.select(*keys, F.col("pos").alias("i"), "value", F.explode(F.array(*(F.struct(F.lit(o).alias("other"), F.col(f"`{o}`").alias("x")) for o in others))).alias("o"))
    pairs = pairs.select(*keys, "i", "value", "o.*")
    by = [*keys, "other"]
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{a}_{c}") for c in ("value", "x") for a, f in (("low", F.min), ("high", F.max))))
    long = pairs.join(g, by).filter("n >= 30 AND low_value < high_value AND low_x < high_x")

    def lagged(y: np.ndarray, x: np.ndarray, k: int, top: int, a: int, b: int) -> np.ndarray:
        """Columns 1, k lags of y, k of x, y, at the places they have with ``top`` lags."""
        return np.column_stack([np.ones(b - a), *(z[a - i : b - i] for z in (y, x) for i in range(1, k + 1)), y[a:b]])

    def block(pdf: pd.DataFrame, own: int) -> list[tuple]:
        y, x = pdf["value"].to_numpy(float), pdf["x"].to_numpy(float)
        n, low = int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0])
        top = most(n)
        a = max(own, top - low)
        r = factor_in_pieces(lambda p, q: lagged(y, x, top, top, p, q), a, max(a, len(y)), width(top))
        head = [float(n), *y[: 2 * top], *x[: 2 * top]] if low == 0 and own == 0 else [float(n)]
        return [(width(top), r.ravel(), max(0, len(y) - a), head)]

    parts = per_block(with_halo(long, F.lit(12), size), by, block, "width int, r array<double>, rows long, head array<double>")
    merged = merge_factors(parts, by, blocks_of(pairs, by, size))

    def test(pdf: pd.DataFrame) -> list[tuple]:
        w, head = int(pdf["width"].iloc[0]), np.asarray(pdf["head"].iloc[0], float)
        n, top = int(head[0]), (w - 2) // 2
        y, x = head[1 : 1 + len(head) // 2], head[1 + len(head) // 2 :]
        r, best = np.asarray(pdf["r"].iloc[0], float).reshape(-1, w), None
        for k in range(1, top + 1):
            columns = [0, *range(1, k + 1), *range(top + 1, top + k + 1), w - 1]
            whole = factor(np.vstack([r[:, columns], lagged(y, x, k, top, k, top)]))
            r0 = ols(whole, list(range(k + 1)), n - k)[2]
            r1 = ols(whole, list(range(2 * k + 1)), n - k)[2]
            stat = (n - k) * (r0 - r1) / max(r1, 1e-300)
            p = chi2_upper(max(stat, 0.0), k)
            if best is None or p < best[2]:
                best = (k, float(stat), float(p))
        return [best]

    return per_key(merged, by, test, "lags int, chi2 double, p double")


# --- lags ---------------------------------------------------------------------------------------


def lag_products(x: DataFrame, keys: list[str], back: Column, most: int, size: int = SIZE) -> DataFrame:
    """Rows (keys, lag, c): sums of ``e`` times ``e`` ``lag`` positions earlier, lags 0..``back`` (at most ``most``)."""

    def block(pdf: pd.DataFrame, own: int) -> list[tuple]:
        pos, first = pdf["pos"].to_numpy(), int(pdf["first"].iloc[0])
        e = np.zeros(int(pos[-1]) - (first - most) + 1)  # by position; a place without a value adds nothing
        e[pos - (first - most)] = np.nan_to_num(pdf["e"].to_numpy(float))
        own_part = e[most:]
        return [(lag, float(own_part @ e[most - lag : len(e) - lag])) for lag in range(int(pdf["back"].iloc[0]) + 1)]

    spread = with_halo(x.withColumn("back", back), F.col("back"), size, "pos")
    return per_block(spread, keys, block, "lag int, c double", "pos").groupBy(*keys, "lag").agg(F.sum("c").alias("c"))


def paired(x: DataFrame, keys: list[str], lags: int | Column, most: int, columns: Callable[[pd.DataFrame, int], tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> DataFrame:
    """Rows (keys, lag, r): Pearson's r of ``columns(points, lag)`` - a later and an earlier column - over all pairs ``lag`` positions apart."""

    def block(pdf: pd.DataFrame, own: int) -> list[tuple]:
        pos, first, out = pdf["pos"].to_numpy(), int(pdf["first"].iloc[0]), []
        at = np.full(int(pos[-1]) - (first - most) + 1, -1)
        at[pos - (first - most)] = np.arange(len(pos))
        later = at[most:]
        for lag in range(1, int(pdf["lags"].iloc[0]) + 1):
            earlier = at[most - lag : len(at) - lag]
            a, b = columns(pdf, lag)
            ok = (later >= 0) & (earlier >= 0)
            y, z = a[later[ok]], b[earlier[ok]]
            ok = ~(np.isnan(y) | np.isnan(z))
            y, z = y[ok], z[ok]
            if len(y):
                out.append((lag, len(y), float(y.mean()), float(z.mean()), float(((y - y.mean()) ** 2).sum()), float(((z - z.mean()) ** 2).sum()), float(((y - y.mean()) * (z - z.mean())).sum())))
        return out

    spread = with_halo(x.withColumn("lags", F.lit(lags) if isinstance(lags, int) else lags), F.col("lags"), size, "pos")
    parts = per_block(spread, keys, block, "lag int, m double, my double, mz double, yy double, zz double, yz double", "pos")
    # moments of the blocks, each about its own mean, are joined about the common mean
    whole = parts.groupBy(*keys, "lag").agg(
        F.sum("m").alias("n"), F.sum(F.expr("m * my")).alias("sy"), F.sum(F.expr("m * mz")).alias("sz"), F.collect_list(F.struct("m", "my", "mz", "yy", "zz", "yz")).alias("p")
    )
    cross = lambda a, b, own: F.aggregate(
        "p", F.lit(0.0), lambda acc, v: acc + v[own] + v["m"] * (v[f"m{a}"] - F.col(f"s{a}") / F.col("n")) * (v[f"m{b}"] - F.col(f"s{b}") / F.col("n"))
    )
    out = whole.select(*keys, "lag", cross("y", "y", "yy").alias("yy"), cross("z", "z", "zz").alias("zz"), cross("y", "z", "yz").alias("yz"))
    return out.select(*keys, "lag", F.when((F.col("yy") > 0) & (F.col("zz") > 0), F.col("yz") / F.sqrt(F.col("yy") * F.col("zz"))).alias("r"))


# --- scans --------------------------------------------------------------------------------------


def _in_blocks(s: DataFrame, size: int) -> DataFrame:
    return s.withColumn("__block", F.floor(F.col("pos") / size))


def ewma(s: DataFrame, keys: list[str], span: int | None = None, size: int = SIZE) -> DataFrame:
    """Rows with ``ewma``: the first value, then (1 - alpha) times the one before plus alpha times the value, alpha = 2 / (span + 1).

    Without a span, a tenth of the series' rows, at least 2. Nulls take the average before them.
    """
    x = _in_blocks(s, size)
    if span is None:
        n = s.groupBy(*keys).agg((2.0 / (F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) / 10)) + 1)).alias("__alpha"))
        x = x.join(n, keys)
    else:
        x = x.withColumn("__alpha", F.lit(2.0 / (span + 1)))
    fields = [f for f in x.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """From zero; ``__m`` counts the values so far."""
        pdf = pdf.sort_values("pos", ignore_index=True)
        v = pdf["value"].to_numpy(float)
        known = ~np.isnan(v)
        m = np.cumsum(known)
        run = pd.Series(np.concatenate([[0.0], v[known]])).ewm(alpha=float(pdf["__alpha"].iloc[0]), adjust=False).mean().to_numpy()
        return pdf.assign(__local=run[m], __m=m)

    local = x.groupBy(*keys, "__block").applyInPandas(scan, f"{schema}, __local double, __m long")
    ends = local.groupBy(*keys, "__block").agg(
        F.max_by("__local", "pos").alias("last"), F.max("__m").alias("m"), F.max("__alpha").alias("alpha"), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("value")
    )

    def carry(pdf: pd.DataFrame) -> list[tuple]:
        out, now = [], np.nan
        for b, last, m, alpha, value in zip(*(pdf[c] for c in ("__block", "last", "m", "alpha", "value"))):
            began = not np.isnan(now)
            now = now if began or value is None else value  # the first value enters itself
            out.append((int(b), float(now), began))
            now = last + (1 - alpha) ** m * now
        return out

    entering = per_key(ends, keys, carry, "__block long, __enters double, __began boolean", "__block")
    e = F.col("__local") + F.pow(1 - F.col("__alpha"), F.col("__m")) * F.col("__enters")
    out = local.join(entering, [*keys, "__block"])
    return out.select(*s.columns, F.when((F.col("__began") | (F.col("__m") > 0)) & ~F.isnan("__enters"), e).alias("ewma"))


def cusum(s: DataFrame, keys: list[str], slack: DataFrame | float = 0.0, size: int = SIZE) -> DataFrame:
    """Rows with ``up`` and ``down``: cumulated deviations beyond the slack, from zero, never below it."""
    g = s.groupBy(*keys).agg(F.avg("value").alias("__m"))
    x = _in_blocks(s, size).join(g, keys)
    if isinstance(slack, DataFrame):
        x, k = x.join(slack, keys), F.col("slack")
    else:
        k = F.lit(float(slack))
    d = F.col("value") - F.col("__m")
    w = Window.partitionBy(*keys, "__block").orderBy("pos")
    x = x.withColumns({"__u": F.when(F.col("pos") == 0, 0.0).otherwise(d - k), "__d": F.when(F.col("pos") == 0, 0.0).otherwise(-d - k)})
    x = x.withColumns({f"__c{c}": F.sum(f"__{c}").over(w) for c in "ud"})
    x = x.withColumns({f"__l{c}": F.min(f"__c{c}").over(w) for c in "ud"})
    ends = x.groupBy(*keys, "__block").agg(*(F.sum(f"__{c}").alias(f"s{c}") for c in "ud"), *(F.min(f"__c{c}").alias(f"l{c}") for c in "ud"))
    b = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
    ends = ends.withColumns({f"before_{c}": F.coalesce(F.sum(f"s{c}").over(b), F.lit(0.0)) for c in "ud"})
    ends = ends.withColumns({f"least_{c}": F.min(F.col(f"before_{c}") + F.col(f"l{c}")).over(b) for c in "ud"})
    out = x.join(ends.select(*keys, "__block", *(f"{p}_{c}" for p in ("before", "least") for c in "ud")), [*keys, "__block"])
    level = {c: F.col(f"before_{c}") + F.col(f"__c{c}") for c in "ud"}
    lowest = {c: F.least(F.col(f"least_{c}"), F.col(f"before_{c}") + F.col(f"__l{c}")) for c in "ud"}
    return out.select(*keys, "pos", "ts", "value", (level["u"] - lowest["u"]).alias("up"), (level["d"] - lowest["d"]).alias("down"))


def running_sums(s: DataFrame, keys: list[str], columns: dict[str, Column], size: int = SIZE) -> DataFrame:
    """Add the running sum of each of ``columns`` in the order of ``pos``; nulls count as zero."""
    w = Window.partitionBy(*keys, "__block").orderBy("pos")
    x = _in_blocks(s, size).withColumns({f"__v{c}": F.coalesce(v.cast("double"), F.lit(0.0)) for c, v in columns.items()})
    x = x.withColumns({f"__r{c}": F.sum(f"__v{c}").over(w) for c in columns})
    ends = x.groupBy(*keys, "__block").agg(*(F.sum(f"__v{c}").alias(f"__s{c}") for c in columns))
    b = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__block", *(F.coalesce(F.sum(f"__s{c}").over(b), F.lit(0.0)).alias(f"__b{c}") for c in columns))
    return x.join(ends, [*keys, "__block"]).select(*s.columns, *((F.col(f"__b{c}") + F.col(f"__r{c}")).alias(c) for c in columns))


def windowed(s: DataFrame, keys: list[str], frames: dict[str, tuple[Column, Column]], size: int = SIZE) -> DataFrame:
    """Add ``mean_x``, ``std_x`` and ``n_x`` of the values from ``back`` rows before to ``ahead`` rows after, for each frame x: (back, ahead).

    Frames are expressions of ``n``, the rows of a series; so windows as long as a share of it
    cost no more than short ones: they are differences of two running sums, looked up by position.
    """
    w = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("__mean"))
    x = s.join(w, keys).withColumn("__e", F.col("value") - F.col("__mean"))
    sums = {"__s1": F.col("__e"), "__s2": F.col("__e") * F.col("__e"), "__c": F.when(F.col("value").isNotNull(), F.lit(1.0))}
    x = running_sums(x, keys, sums, size)
    at = x.select(*keys, F.col("pos").alias("__at"), *sums)
    out, found = x, []
    for name, (back, ahead) in frames.items():
        begin, end = F.col("pos") - back - 1, F.least(F.col("pos") + ahead, F.col("n") - 1)
        sides = {}
        for side, place in (("l", begin), ("h", end)):
            look = at.select(*keys, F.col("__at").alias("__look"), *(F.col(c).alias(f"{c}_{side}_{name}") for c in sums))
            out = out.withColumn("__look", place).join(look, [*keys, "__look"], "left").drop("__look")
            sides[side] = {c: F.coalesce(F.col(f"{c}_{side}_{name}"), F.lit(0.0)) for c in sums}
        s1, s2, c = (sides["h"][k] - sides["l"][k] for k in ("__s1", "__s2", "__c"))
        mean = F.try_divide(s1, c)
        spread = F.greatest(s2 - s1 * mean, F.lit(0.0))
        found += [(F.col("__mean") + mean).alias(f"mean_{name}"), F.when(c >= 2, F.sqrt(spread / (c - 1))).alias(f"std_{name}"), c.cast("long").alias(f"n_{name}")]
    return out.select(*s.columns, "n", *found)
