"""Numbers behind charts: histograms, densities, boxes, quantile plots, bars, calendars, pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import correlation, name, numeric_columns, share
from tidewell.functions.dist import z_of
from tidewell.operators.ranks import exact_quantiles, running_before

SQRT = lambda n: F.least(F.greatest(F.floor(F.sqrt(n)), F.lit(10)), F.lit(50)).cast("int")
STURGES = lambda n: F.least(F.greatest(F.ceil(F.log2(n.cast("double"))) + 1, F.lit(5)), F.lit(50)).cast("int")


def full_analysis(df: DataFrame) -> dict[str, DataFrame]:
    """The analysis of a whole table, lazily: correlations, strongest pairs, the box plot by groups, missing values, outliers, normality."""
    from tidewell.operators import assoc, outliers, profile, tests_stat

    numeric = numeric_columns(df)
    out = {"missing": profile.missing_table(df), "quality": profile.quality_score(df)}
    if len(numeric) > 1:
        out |= {"correlation": assoc.correlation_p(assoc.pearson(df, numeric)), "scatter": top_pairs(df)}
    if numeric:
        out |= {"outliers": outliers.outlier_summary(df), "normality": tests_stat.normality_table(df)}
    if picked := pick_grouped_box(df):
        out["grouped_box"] = boxes(df, picked[0], [picked[1]])
    return out


def column_analysis(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """The charts of one column, by its kind."""
    kind = df.schema[column].dataType.simpleString()
    if column in numeric_columns(df):
        return {
            "histogram": histogram(df, column), "density": density(df, column), "box": boxes(df, column), "qq": qq_plot(df, column),
            "ecdf": ecdf(df, column)
        }
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return {"over_time": counts_over_time(df, column), "seasonality": seasonality(df, column)}
    return {"bars": bars(df, column), "others": others(df, column), "pie": pie(df, column)}


def histogram(df: DataFrame, column: str, bins: int | None = None, rule=SQRT) -> DataFrame:
    """Rows (bin, lo, hi, n): equal widths, the last bin closed, empty bins kept."""
    c = name(column).cast("double")
    s = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("total")).filter("total > 0")
    s = s.withColumn("k", F.lit(bins) if bins else rule(F.col("total")))
    s = s.withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("k")).otherwise(F.lit(1.0)))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.col("k") - 1).cast("int")
    counted = df.select(c.alias("x")).filter("x IS NOT NULL").crossJoin(F.broadcast(s)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = s.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "lo", "w")
    out = grid.join(F.broadcast(counted), "bin", "left")
    return out.select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Rows (i, x, density): Gaussian kernel, Scott's bandwidth, equal values counted once."""
    c = name(column).cast("double")
    s = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("total"), F.stddev_samp(c).alias("s")).filter("total > 1 AND s > 0")
    grid = s.select(
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi", "total",
        (F.col("s") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).alias("h")
    )
    grid = grid.withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1))
    counts = df.select(c.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    u = (F.col("x") - F.col("v")) / F.col("h")
    out = counts.crossJoin(F.broadcast(grid)).groupBy("i", "x").agg((F.sum(F.col("n") * F.exp(-0.5 * u * u)) / (F.first("total") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))
    return out


def boxes(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Box statistics per group: quartiles, whiskers at the last point within 1.5 IQR, mean, outliers."""
    by, c = by or [], name(column).cast("double")
    rows = df.select(*(name(b) for b in by), c.alias("x")).filter("x IS NOT NULL")
    q = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    quartiles = exact_quantiles(rows, by, F.col("x"), [0.25, 0.5, 0.75])
    q = q.join(quartiles, by) if by else q.crossJoin(F.broadcast(quartiles))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "n", "mean", "min", "max")
    joined = rows.join(F.broadcast(q.select(*by, "q1", "q3")), by) if by else rows.crossJoin(F.broadcast(q.select("q1", "q3")))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - fence) & (F.col("x") <= F.col("q3") + fence)
    w = joined.groupBy(*by).agg(
        F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("outliers")
    )
    return q.join(F.broadcast(w), by) if by else q.crossJoin(F.broadcast(w))


def box_outliers(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """The outliers themselves, smallest first, at most ``limit``."""
    b = boxes(df, column).select("low", "high")
    return df.select(name(column).cast("double").alias("x")).crossJoin(F.broadcast(b)).filter("x < low OR x > high").select("x").orderBy("x").limit(limit)


def qq_plot(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n, quantile): normal quantiles at the mean plotting position of each value."""
    counts = df.filter(name(column).isNotNull()).groupBy(name(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    r = running_before(counts, "value", ["n"]).crossJoin(F.broadcast(total))
    i = F.col("before_n") + (F.col("n") + 1) / 2
    p = F.when(F.col("total") == 1, F.lit(0.5)).when(
        i >= F.col("total"), F.pow(F.lit(0.5), 1 / F.col("total"))
    ).when(i <= 1, 1 - F.pow(F.lit(0.5), 1 / F.col("total"))).otherwise((i - 0.3175) / (F.col("total") + 0.365))
    return r.select("value", "n", p.alias("position")).withColumn("quantile", z_of(F.col("position")))


def qq_line(points: DataFrame) -> DataFrame:
    """One row (slope, intercept, r) of the least-squares line, weighted by n."""
    w, x, y = F.col("n"), F.col("quantile"), F.col("value")
    s = points.agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"),
        F.sum(w * y * y).alias("yy")
    )
    sxy, sxx, syy = (F.expr(e) for e in ("xy - x * y / w", "xx - x * x / w", "yy - y * y / w"))
    slope = F.try_divide(sxy, sxx)
    return s.select(slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"), F.try_divide(sxy, F.sqrt(sxx * syy)).alias("r"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, p): share of values up to and including each distinct value."""
    counts = df.filter(name(column).isNotNull()).groupBy(name(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return running_before(counts, "value", ["n"]).crossJoin(F.broadcast(total)).select("value", ((F.col("before_n") + F.col("n")) / F.col("total")).alias("p"))


def thin(df: DataFrame, position: str, total: Column, points: int) -> DataFrame:
    """About ``points`` evenly spaced rows by 0-based position, the first and last included."""
    n = df.agg(total.alias("__n"))
    picks = n.select(F.explode(F.sequence(F.lit(0), F.least(F.lit(points), F.col("__n")).cast("int") - 1)).alias("__k"), "__n")
    step = F.when(F.col("__n") <= points, F.col("__k")).otherwise(F.bround(F.col("__k") * (F.col("__n") - 1) / (points - 1)))
    picks = picks.select(step.cast("long").alias(position)).distinct()
    return df.join(F.broadcast(picks), position)


def bars(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Rows (rank, value, n, pct, cumulative_pct) of the top values; ties by value."""
    counts = df.filter(name(column).isNotNull()).groupBy(name(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(k)  # at most k rows in the windows below
    w = Window.orderBy(F.col("n").desc(), "value")
    out = top.crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(w).cast("long"))
    return out.select(
        "rank", "value", "n", share(F.col("n"), F.col("total")).alias("pct"),
        share(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("total")).alias("cumulative_pct")
    )


def others(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """One row (other_count): values beyond the top ones."""
    top = bars(df, column, k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top"))
    return df.agg(F.count(name(column)).alias("all")).crossJoin(F.broadcast(top)).select((F.col("all") - F.col("top")).alias("other_count"))


def pie(df: DataFrame, column: str, k: int = 8, most: int = 15) -> DataFrame:
    """Rows (label, n): the top values and 'Other'; none with more than ``most`` categories."""
    distinct = df.agg(F.count_distinct(name(column)).alias("__d"))
    top = bars(df, column, k).select(F.col("value").alias("label"), "n")
    rest = others(df, column, k).select(F.lit("Other").alias("label"), F.col("other_count").alias("n")).filter("n > 0")
    return top.unionByName(rest).crossJoin(F.broadcast(distinct)).filter(F.col("__d") <= most).select("label", "n")


def per_day(df: DataFrame, column: str, weekly: bool = False) -> DataFrame:
    """Rows (day, n) of rows per day, or per week named by its Sunday, empty weeks kept."""
    day = F.to_date(name(column))
    if not weekly:
        return df.filter(name(column).isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    week = F.next_day(F.date_sub(day, 1), "SUN")
    n = df.filter(name(column).isNotNull()).groupBy(week.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    grid = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("day"))
    return grid.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_over_time(df: DataFrame, column: str, most_days: int = 500) -> DataFrame:
    """Daily counts, or weekly ones when the days would be too many."""
    span = df.agg(F.datediff(F.max(name(column)), F.min(name(column))).alias("d")).first()["d"]
    return per_day(df, column, weekly=(span or 0) > most_days)


def seasonality(df: DataFrame, column: str) -> DataFrame:
    """Rows (unit, part, n) by hour, weekday (Monday 0) and month, from one pass."""
    c = name(column)
    units = F.array(*(F.struct(F.lit(u).alias("unit"), f(c).alias("part")) for u, f in (("hour", F.hour), ("weekday", F.weekday), ("month", F.month))))
    return df.filter(c.isNotNull()).select(F.explode(units).alias("x")).groupBy("x.unit", "x.part").agg(F.count(F.lit(1)).alias("n"))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, slope, intercept, r, r2) over complete pairs."""
    a, b = name(x).cast("double"), name(y).cast("double")
    both = df.select(a.alias("x"), b.alias("y")).dropna()
    s = both.agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"),
        F.var_pop("y").alias("vy")
    )
    slope, r = F.try_divide(F.col("c"), F.col("vx")), F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy")))
    return s.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), r.alias("r"), (r * r).alias("r2"))


def top_pairs(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Rows (column_a, column_b, r): strongest pairs of columns that are less than 95 % unique."""
    from tidewell.operators.profile import _pairs

    columns = columns or numeric_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(name(c)).alias(f"d{i}") for i, c in enumerate(columns))).first()
    kept = [c for i, c in enumerate(columns) if row[f"d{i}"] < 0.95 * row["n"]]
    pairs = [(a, b, correlation(name(a), name(b))) for i, a in enumerate(kept) for b in kept[i + 1 :]]
    return _pairs(df, pairs, ("column_a", "column_b"), "r").filter("r IS NOT NULL").orderBy(F.abs("r").desc(), "column_a", "column_b").limit(k)


def grouped_boxes(df: DataFrame, value: str, by: str, top: int = 12, least: int = 3) -> DataFrame:
    """Boxes per group for the ``top`` largest groups with at least ``least`` rows."""
    groups = df.filter(name(by).isNotNull() & name(value).isNotNull()).groupBy(name(by)).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    groups = groups.orderBy(F.col("__n").desc(), by).limit(top).select(by)
    return boxes(df.join(F.broadcast(groups), by, "left_semi"), value, [by])


def pick_grouped_box(df: DataFrame) -> tuple[str, str] | None:
    """The numeric column of largest variance and the grouping column with fewest values (2 to 15)."""
    numeric = numeric_columns(df)
    others_ = [c for c in df.columns if c not in numeric]
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *(F.var_samp(name(c).cast("double")).alias(f"v{i}") for i, c in enumerate(numeric)),
        *(F.approx_count_distinct(name(c)).alias(f"d{i}") for i, c in enumerate(numeric)),
        *(F.approx_count_distinct(name(c)).alias(f"g{i}") for i, c in enumerate(others_))
    ).first()
    values = [(row[f"v{i}"] or 0, c) for i, c in enumerate(numeric) if row[f"d{i}"] > 0.05 * row["n"]]
    groups = [(row[f"g{i}"], c) for i, c in enumerate(others_) if 2 <= row[f"g{i}"] <= 15]
    return (max(values)[1], min(groups)[1]) if values and groups else None


def cross_table(df: DataFrame, a: str, b: str, top: int = 10) -> DataFrame:
    """Rows (a, b, n) of the top values of either column."""
    x, y = (bars(df, c, top).select(F.col("value").alias(v)) for c, v in ((a, "a"), (b, "b")))
    rows = df.select(name(a).cast("string").alias("a"), name(b).cast("string").alias("b"))
    return rows.join(F.broadcast(x), "a", "left_semi").join(F.broadcast(y), "b", "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows for a point cloud, drawn by a hash of the keys."""
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    draw = F.pmod(F.xxhash64(*(name(k) for k in keys)), F.lit(1 << 30))
    return df.crossJoin(F.broadcast(total)).filter(draw * F.col("__t") < F.lit(float(1 << 30)) * rows).drop("__t")


def scatter3d(df: DataFrame, columns: list[str], keys: list[str], rows: int = 2000) -> DataFrame:
    return hash_sample(df.select(*{*keys, *columns}).dropna(subset=columns), keys, rows).select(*columns)


def principal_components(df: DataFrame, columns: list[str], k: int = 2, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores (keys, pc1..) and loadings (component, column_name, loading, explained) on standardised complete rows."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.select(*(keys or []), *(name(c).cast("double").alias(c) for c in columns)).dropna(subset=columns)
    made = VectorAssembler(inputCols=columns, outputCol="__v").transform(rows)
    made = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(made).transform(made)
    model = PCA(k=k, inputCol="__s", outputCol="__p").fit(made)
    axes = model.pc.toArray()
    sign = [1.0 if axes[abs(axes[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    loadings = [(f"pc{j + 1}", c, float(axes[i, j] * sign[j]), float(model.explainedVariance[j])) for j in range(k) for i, c in enumerate(columns)]
    scores = model.transform(made).withColumn("__a", vector_to_array("__p"))
    scores = scores.select(*(keys or []), *((F.col("__a")[j] * sign[j]).alias(f"pc{j + 1}") for j in range(k)))
    return scores, df.sparkSession.createDataFrame(loadings, "component string, column_name string, loading double, explained double")
