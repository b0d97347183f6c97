"""Association between columns: numeric, categorical and mixed pairs, with insights.

All numeric pairs come from one aggregate; all pairs that need groups are unpivoted
once and grouped once, so the number of jobs does not grow with the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.cleaning import TEMPORAL, correlation, is_numeric, name, numeric_columns
from tidewell.functions.dist import p_chi2, p_f, p_normal, p_t
from tidewell.operators.profile import _pairs
from tidewell.operators.ranks import repeated, with_rank


def column_roles(df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """Rows (column_name, role, distinct_n): numeric, categorical, datetime, or empty when all null."""
    from tidewell.operators.profile import distinct_counts

    roles = F.create_map(*(F.lit(x) for f in df.schema.fields for x in (
        f.name, "numeric" if is_numeric(df, f.name) else "datetime" if isinstance(f.dataType, TEMPORAL) else "categorical"
    )))
    out = distinct if distinct is not None else distinct_counts(df)
    return out.select("column_name", F.when(F.col("distinct_n") == 0, "empty").otherwise(roles[F.col("column_name")]).alias("role"), "distinct_n")


#: Most buckets a column is cut into for Kendall's tau; the grid has at most its square of cells.
KENDALL_BUCKETS = 512


def numeric_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (column_a, column_b, r, n) over pairwise complete rows, in one aggregate."""
    columns = columns or numeric_columns(df)
    pairs = numeric_pairs(columns)
    r = _pairs(df, [(a, b, correlation(name(a), name(b))) for a, b in pairs], ("column_a", "column_b"), "r")
    n = _pairs(df, [(a, b, F.count_if(name(a).isNotNull() & name(b).isNotNull()).cast("double")) for a, b in pairs], ("column_a", "column_b"), "n")
    return r.join(F.broadcast(n), ["column_a", "column_b"]).withColumn("n", F.col("n").cast("long"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r, n): Pearson correlation of average ranks within the pair's complete rows."""
    rows = df.select(name(a).cast("double").alias("a"), name(b).cast("double").alias("b")).dropna()
    ranked = with_rank(with_rank(rows, "a", "ra"), "b", "rb")
    return ranked.agg(correlation(F.col("ra"), F.col("rb")).alias("r"), F.count(F.lit(1)).alias("n"))


def concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant minus discordant pairs of weighted points, ties counting nothing: a merge count."""
    cells = pd.DataFrame({"x": x, "y": y, "n": n}).groupby(["x", "y"], sort=True)["n"].sum().reset_index()
    w = cells["n"].to_numpy(float)
    rank = np.unique(cells["y"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    same_x = np.bincount(np.unique(cells["x"].to_numpy(), return_inverse=True)[1], w)
    total = 0.0
    m, width = len(w), 1
    top = int(rank.max()) + 1 if m else 1
    while width < m:  # blocks of ``width`` points, in order of x, each pair of neighbours merged by y
        block = np.arange(m) // width
        order = np.lexsort((rank, block))
        key, side, weight = (block // 2 * top + rank)[order], block[order] % 2, w[order]
        left = side == 0
        at, sums = key[left], np.concatenate(([0.0], np.cumsum(weight[left])))
        start = sums[np.searchsorted(at, key[~left] // top * top)]
        less = sums[np.searchsorted(at, key[~left], "left")] - start
        upto = sums[np.searchsorted(at, key[~left], "right")] - start
        whole = sums[np.searchsorted(at, (key[~left] // top + 1) * top)] - start
        total += float((weight[~left] * (less - (whole - upto))).sum())
        width *= 2
    # points of one x stand in order of y and were counted as concordant
    return total - float((same_x**2).sum() - (w**2).sum()) / 2


def kendall(df: DataFrame, a: str, b: str, cell_rows: int = 100_000) -> DataFrame:
    """One row (tau, z, n): tau-b from distinct value pairs with counts.

    Both columns are cut at quantiles into buckets of about ``cell_rows`` distinct
    pairs. Pairs of points in different buckets of both columns are counted on the grid
    of bucket counts, those that share a bucket by a merge count inside it; so no
    two rows are ever joined, and the cost is that of sorting. A value that fills a
    bucket has one of its own, and no work in it: its pairs are ties.
    """
    rows = df.select(name(a).cast("double").alias("x"), name(b).cast("double").alias("y")).dropna()
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    edges = [F.percentile_approx(c, [i / KENDALL_BUCKETS for i in range(1, KENDALL_BUCKETS)], 10_000).alias(f"e{c}") for c in "xy"]
    size = F.count(F.lit(1)).alias("cells")
    # small inputs take one bucket, larger ones as many as keep a bucket near cell_rows
    step = F.greatest(F.lit(1), F.floor(F.lit(KENDALL_BUCKETS) * cell_rows / F.col("cells"))).cast("int")
    cuts = cells.agg(*edges, size).withColumns({f"h{c}": repeated(F.col(f"e{c}")) for c in "xy"})
    # a value that several quantiles are stays an edge
    keep = lambda c: F.filter(F.array_distinct(f"e{c}"), lambda e, i: ((i + 1) % step == 0) | F.array_contains(f"h{c}", e))
    cuts = cuts.select(*(keep(c).alias(f"e{c}") for c in "xy"), "hx", "hy")
    # even numbers are ranges, an odd one a single value at its range's upper end
    bucket = lambda c: (2 * F.size(F.filter(f"e{c}", lambda e: e < F.col(c))) + F.array_contains(f"h{c}", F.col(c)).cast("int")).alias(f"b{c}")
    placed = cells.crossJoin(F.broadcast(cuts)).select("x", "y", "n", bucket("x"), bucket("y"))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [concordance(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["n"].to_numpy())]})

    # same bucket of x; different bucket of x, same bucket of y; the grid itself (different buckets of both)
    by_x = placed.filter("bx % 2 = 0").select(F.lit(0).alias("kind"), F.col("bx").alias("bucket"), F.col("x").alias("u"), F.col("y").alias("v"), "n")
    by_y = placed.filter("by % 2 = 0").groupBy("by", "bx", "y").agg(F.sum("n").alias("n")).select(
        F.lit(1).alias("kind"), F.col("by").alias("bucket"), F.col("bx").cast("double").alias("u"), F.col("y").alias("v"), "n"
    )
    grid = placed.groupBy("bx", "by").agg(F.sum("n").alias("n")).select(
        F.lit(2).alias("kind"), F.lit(0).alias("bucket"), F.col("bx").cast("double").alias("u"), F.col("by").cast("double").alias("v"), "n"
    )
    s = by_x.unionByName(by_y).unionByName(grid).groupBy("kind", "bucket").applyInPandas(within, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))

    def ties(c: str) -> DataFrame:
        t = F.col("t").cast("double")
        g = cells.groupBy(c).agg(F.sum("n").alias("t"))
        return g.agg((F.sum(t * (t - 1)) / 2).alias(f"T{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"C{c}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"V{c}"))

    n = cells.agg(F.sum("n").cast("double").alias("n"))
    one = s.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(ties("x"))).crossJoin(F.broadcast(ties("y")))
    m = F.expr("n * (n - 1)")
    tau = F.try_divide(F.col("s"), F.sqrt((m / 2 - F.col("Tx")) * (m / 2 - F.col("Ty"))))
    var = F.expr("(n * (n - 1) * (2 * n + 5) - Vx - Vy) / 18") + F.try_divide(F.expr("2 * Tx * Ty"), m) + F.try_divide(
        F.expr("Cx * Cy"), F.expr("9 * n * (n - 1) * (n - 2)")
    )
    return one.select(tau.alias("tau"), F.try_divide(F.col("s"), F.sqrt(var)).alias("z"), F.col("n").cast("long").alias("n"))


def correlation_p(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Add p to rows with r and n; null below ``least`` rows."""
    df_ = F.col("n") - 2
    stat = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(df_ / (1 - F.col("r") * F.col("r"))))
    return pairs.withColumn("p", F.when(F.col("n") >= least, F.when(F.abs("r") >= 1, 0.0).otherwise(p_t(stat, df_))))


def kendall_p(row: DataFrame) -> DataFrame:
    return row.withColumn("p", p_normal(F.col("z")))


def vif(df: DataFrame, columns: list[str] | None = None, most: int = 15) -> DataFrame:
    """Rows (column_name, vif, truncated) on complete rows: the diagonal of the inverse correlation matrix.

    One aggregate makes the matrix (``most`` columns at the most); inverting it is the driver's part.
    """
    every = columns or numeric_columns(df)
    used = every[:most]
    rows = df.select(*(name(c).cast("double").alias(c) for c in used)).dropna()
    pairs = numeric_pairs(used)
    # rows are complete, so a deviation per column and a covariance per pair are enough
    spread = [F.when(F.min(name(c)) < F.max(name(c)), F.stddev_pop(name(c))).alias(f"s{i}") for i, c in enumerate(used)]
    got = rows.agg(*spread, *(F.covar_pop(name(a), name(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    m, sd = np.eye(len(used)), dict(zip(used, got))
    for (a, b), c in zip(pairs, got[len(used) :]):
        m[used.index(a), used.index(b)] = m[used.index(b), used.index(a)] = c / (sd[a] * sd[b]) if sd[a] and sd[b] else 0.0
    inverse = np.linalg.pinv(m) if np.linalg.matrix_rank(m) < len(used) else np.linalg.inv(m)
    full = np.linalg.matrix_rank(m) == len(used)
    made = [(c, float(inverse[i, i]) if full and inverse[i, i] < 1e12 else float("inf"), len(every) > most) for i, c in enumerate(used)]
    return df.sparkSession.createDataFrame(made, "column_name string, vif double, truncated boolean")


# --- categorical pairs -------------------------------------------------------------------


def contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (column_a, column_b, a, b, o) of all pairs: one unpivot, one group."""
    items = F.array(*(
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), name(a).cast("string").alias("a"), name(b).cast("string").alias("b")) for a,
        b in pairs
    ))
    return df.select(F.explode(items).alias("x")).select("x.*").filter("a IS NOT NULL AND b IS NOT NULL").groupBy("column_a", "column_b", "a", "b").agg(F.count(F.lit(1)).alias("o"))


PAIR = ["column_a", "column_b"]


def categorical_matrix(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """Rows (column_a, column_b, n, chi2, dof, cramers_v, theils_u_ab): both directions' U need both orders.

    Chi-square counts empty cells too; V is bias-corrected; U(a|b) is the share of
    a's entropy that b explains. Pairs with few rows or one level are left out.
    """
    cells = contingency(df, numeric_pairs(columns))
    rows, cols, sizes = (cells.groupBy(*PAIR, *k).agg(F.sum("o").alias(c)) for k, c in ((["a"], "ra"), (["b"], "cb"), ([], "n")))
    m = cells.join(rows, [*PAIR, "a"]).join(cols, [*PAIR, "b"]).join(F.broadcast(sizes), PAIR)
    o, ra, cb, n = (F.col(c).cast("double") for c in ("o", "ra", "cb", "n"))
    # sums over levels: each level's total is shared out over its cells
    g = m.groupBy(*PAIR).agg(
        F.max("n").alias("n"), F.sum(o * o / (ra * cb)).alias("q"), F.sum(-o / n * F.log2(ra / n)).alias("ha"), F.sum(-o / n * F.log2(o / cb)).alias("hab"),
    )
    for t, c in ((rows, "k"), (cols, "l")):  # one row per pair of columns
        g = g.join(F.broadcast(t.groupBy(*PAIR).agg(F.count(F.lit(1)).alias(c))), PAIR)
    g = g.filter((F.col("n") >= least) & (F.col("k") > 1) & (F.col("l") > 1)).withColumn("chi2", F.col("n") * (F.col("q") - 1))
    phi = F.greatest(F.lit(0.0), F.expr("chi2 / n - (k - 1) * (l - 1) / (n - 1)"))
    k2, l2 = F.expr("k - (k - 1) * (k - 1) / (n - 1)"), F.expr("l - (l - 1) * (l - 1) / (n - 1)")
    low = F.least(k2 - 1, l2 - 1)
    v = F.when(low > 0, F.sqrt(phi / low))
    u = F.when(F.col("ha") > 0, (F.col("ha") - F.col("hab")) / F.col("ha")).otherwise(1.0)
    return g.select(*PAIR, "n", "chi2", ((F.col("k") - 1) * (F.col("l") - 1)).cast("long").alias("dof"), v.alias("cramers_v"), u.alias("theils_u"))


def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, chi2, dof, p); Yates' correction for a 2 x 2 table."""
    cells = contingency(df, [(a, b)]).select("a", "b", "o")
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    n = cells.agg(F.sum("o").cast("double").alias("n"))
    size = rows.agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(cols.agg(F.count(F.lit(1)).alias("l")))).crossJoin(F.broadcast(n))
    # empty cells add up to what the others leave: chi2 = n (sum of o^2 / (row total x column total) - 1)
    one = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("q"))
    out = size.crossJoin(F.broadcast(one)).withColumn("dof", (F.col("k") - 1) * (F.col("l") - 1)).withColumn(
        "plain", F.greatest(F.col("n") * (F.col("q") - 1), F.lit(0.0))
    )
    # Yates: in a 2 x 2 table every cell deviates by the same d: plain = d^2 * sum of 1 / e
    four = rows.select("ra").agg(F.sum(1 / F.col("ra").cast("double")).alias("ia")).crossJoin(F.broadcast(cols.agg(F.sum(1 / F.col("cb").cast("double")).alias("ib"))))
    out = out.crossJoin(F.broadcast(four)).withColumn("inverse", F.col("n") * F.col("ia") * F.col("ib"))
    d = F.sqrt(F.try_divide("plain", "inverse"))
    corrected = F.greatest(d - F.least(F.lit(0.5), d), F.lit(0.0))
    chi2 = F.when(F.col("dof") == 1, corrected * corrected * F.col("inverse")).otherwise(F.col("plain"))
    out = out.filter("n IS NOT NULL").select(F.col("n").cast("long").alias("n"), chi2.alias("chi2"), "dof")
    return out.select("n", "chi2", "dof", p_chi2(F.col("chi2"), F.col("dof")).alias("p"))


# --- mixed pairs -----------------------------------------------------------------------------


def groups_of(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (numeric, category, level, n, s, ss) of all numeric x categorical pairs, in one group.

    Values are shifted by their column's mean first, so that sums of squares keep their digits.
    """
    numbers = list(dict.fromkeys(a for a, _ in pairs))
    means = df.agg(*(F.avg(name(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(numbers)))
    items = F.array(*(F.struct(
        F.lit(a).alias("numeric"), F.lit(b).alias("category"), (name(a).cast("double") - F.col(f"__m{numbers.index(a)}")).alias("x"),
        name(b).cast("string").alias("level")
    ) for a, b in pairs))
    x = F.col("x")
    long = df.crossJoin(F.broadcast(means)).select(F.explode(items).alias("i")).select("i.*").filter("x IS NOT NULL AND level IS NOT NULL")
    return long.groupBy("numeric", "category", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))


def mixed_matrix(df: DataFrame, numeric: list[str], categorical: list[str], least: int = 2) -> DataFrame:
    """Rows (numeric, category, n, groups, eta2, f, p): groups of ``least`` rows or more take part in F."""
    g = groups_of(df, [(a, b) for a in numeric for b in categorical])
    key = ["numeric", "category"]
    total = g.groupBy(*key).agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("ss").alias("all_ss"))
    kept = g.filter(F.col("n") >= least).groupBy(*key).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")
    )
    m = kept.join(F.broadcast(total), key).filter("groups > 1")
    all_mean = F.expr("all_s / all_n")
    ssb_all = F.expr("b") - 2 * all_mean * F.col("s") + F.col("n") * all_mean * all_mean
    eta2 = F.try_divide(ssb_all, F.expr("all_ss - all_s * all_s / all_n"))
    ssb, ssw = F.expr("b - s * s / n"), F.expr("ss - b")
    f = F.try_divide(ssb / (F.col("groups") - 1), ssw / F.nullif(F.col("n") - F.col("groups"), F.lit(0)))
    out = m.select(*key, F.col("n"), F.col("groups"), eta2.alias("eta2"), f.alias("f"))
    return out.withColumn("p", p_f(F.col("f"), F.col("groups") - 1, F.col("n") - F.col("groups")))


def point_biserial(df: DataFrame, numeric: str, category: str) -> DataFrame:
    """One row (level, r): the larger of two levels coded 1; null unless there are two levels."""
    rows = df.select(name(numeric).cast("double").alias("x"), name(category).cast("string").alias("c")).dropna()
    s = rows.agg(F.max("c").alias("hi"), F.min("c").alias("lo"))
    j = rows.crossJoin(F.broadcast(s))
    extra = F.count_if(~F.col("c").isin(F.col("hi"), F.col("lo")))
    return j.agg(F.max("hi").alias("level"), F.when(extra == 0, correlation(F.col("x"), (F.col("c") == F.col("hi")).cast("double"))).alias("r"))


def rank_biserial(df: DataFrame, numeric: str, category: str, least: int = 3) -> DataFrame:
    """One row (level_1, level_2, u, r): r = 1 - 2U / (n1 n2) for the two sorted levels."""
    rows = df.select(name(numeric).cast("double").alias("x"), name(category).cast("string").alias("c")).dropna()
    g = with_rank(rows, "x", "rank").groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("rank").alias("s"))
    two = g.agg(
        F.min("c").alias("level_1"), F.max("c").alias("level_2"), F.count(F.lit(1)).alias("k"), F.min_by("n", "c").alias("n1"),
        F.max_by("n", "c").alias("n2"), F.min_by("s", "c").alias("s1")
    )
    two = two.filter((F.col("k") == 2) & (F.least("n1", "n2") >= least)).withColumn("u", F.expr("s1 - n1 * (n1 + 1) / 2"))
    return two.select("level_1", "level_2", "u", (1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))).alias("r"))


def strongest(pairs: DataFrame, value: str, k: int = 25) -> DataFrame:
    keys = [f.name for f in pairs.schema.fields if isinstance(f.dataType, T.StringType)]
    return pairs.filter(name(value).isNotNull()).orderBy(F.abs(name(value)).desc(), *keys).limit(k)


def insight(kind: str, when: Column, message: Column, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), message.alias("message"), F.lit(severity).alias("severity")))


def rules(df: DataFrame, *found: Column) -> DataFrame:
    """The rows that rules make, one row of ``df`` at a time."""
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")


def insights(
    numeric: DataFrame | None = None, inflation: DataFrame | None = None, categorical: DataFrame | None = None, mixed: DataFrame | None = None
) -> DataFrame:
    """Insight rows from the tables given; numeric pairs count only when significant."""
    out = []
    if numeric is not None:
        sure = F.coalesce(F.col("p") < 0.05, F.lit(True)) if "p" in numeric.columns else F.lit(True)
        text = F.format_string("%s and %s: r = %.2f", "column_a", "column_b", "r")
        out.append(rules(
            numeric, insight("correlation", sure & (F.abs("r") >= 0.9), text, "critical"),
            insight("correlation", sure & (F.abs("r") >= 0.7) & (F.abs("r") < 0.9), text, "warning")
        ))
    if inflation is not None:
        text = F.format_string("%s: variance inflation %.1f", "column_name", "vif")
        out.append(rules(
            inflation, insight("multicollinearity", F.col("vif") > 10, text, "critical"),
            insight("multicollinearity", (F.col("vif") > 5) & (F.col("vif") <= 10), text, "warning")
        ))
    if categorical is not None:
        out.append(rules(
            categorical,
            insight("association", F.col("cramers_v") >= 0.7, F.format_string("%s and %s: V = %.2f", "column_a", "column_b", "cramers_v"), "warning")
        ))
    if mixed is not None:
        out.append(rules(mixed, insight(
            "group_effect", (F.col("eta2") >= 0.14) & (F.col("p") < 0.05),
            F.format_string("%s by %s: eta squared = %.2f", "numeric", "category", "eta2"), "info"
        )))
    first, *rest = out
    for r in rest:
        first = first.unionByName(r)
    return first


def correlations(df: DataFrame, methods: tuple[str, ...] = ("numeric", "categorical", "mixed")) -> dict[str, DataFrame]:
    """Only the groups of results that are asked for, lazily."""
    numeric = numeric_columns(df)
    categorical = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    make = {
        "numeric": lambda: correlation_p(pearson(df, numeric)), "categorical": lambda: categorical_matrix(df, categorical),
        "mixed": lambda: mixed_matrix(df, numeric, categorical)
    }
    return {m: make[m]() for m in methods}
