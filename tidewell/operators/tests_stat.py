"""Hypothesis tests: the statistic by aggregation, the p-value on the one-row result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import name, number, numeric_columns
from tidewell.functions.dist import p_kolmogorov, p_normal, p_t, z_of
from tidewell.operators.assoc import chi2_test, mixed_matrix
from tidewell.operators.ranks import running_before


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(number(name(column)).alias("x")).filter("x IS NOT NULL")


def shapiro_by(rows: DataFrame, keys: list[str], value: Column, most: int = 5000) -> DataFrame:
    """Rows (keys, n, w, p, sampled): Royston's algorithm per group.

    Groups longer than ``most`` are sampled by a hash of the values, the same in
    every run: a value with c copies gives ``c * most / n`` of them, rounded by its hash.
    """
    counts = rows.select(*keys, value.cast("double").alias("x")).filter("x IS NOT NULL").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("t"))
    draw = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    take = F.when(F.col("t") <= most, F.col("c")).otherwise(F.floor(F.col("c") * F.lit(float(most)) / F.col("t") + draw))
    some = counts.join(total, keys).withColumn("take", take).filter("take > 0").select(
        *keys, "x", (F.col("t") > most).alias("sampled"), F.explode(F.expr("sequence(1, take)")).alias("copy")
    ).drop("copy")
    w = Window.partitionBy(*keys).orderBy("x")  # about ``most`` rows
    means = some.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mean"))
    one = some.withColumn("i", F.row_number().over(w)).join(means, keys)
    one = one.filter("n >= 4").withColumn("m", z_of((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    s = one.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.max("m").alias("m1"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("m2")
    )
    u = 1 / F.sqrt("n")
    a1 = F.col("m1") / F.sqrt("mm") + 0.221157 * u - 0.147981 * u**2 - 2.07119 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a2 = F.col("m2") / F.sqrt("mm") + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    s = s.withColumns({"a1": a1, "a2": a2})
    big = F.expr("(mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)")
    small = F.expr("(mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)")
    s = s.withColumn("eps", F.when(F.col("n") > 5, big).otherwise(small)).drop("n")
    j = one.join(s, keys)
    rest = F.col("m") / F.sqrt("eps")
    a = F.when(F.col("i") == F.col("n"), F.col("a1")).when(F.col("i") == 1, -F.col("a1"))
    a = a.when((F.col("n") > 5) & (F.col("i") == F.col("n") - 1), F.col("a2")).when((F.col("n") > 5) & (F.col("i") == 2), -F.col("a2")).otherwise(rest)
    d = F.col("x") - F.col("mean")
    out = j.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("sampled").alias("sampled"), F.sum(a * F.col("x")).alias("ax"), F.sum(d * d).alias("ss")
    ).select(*keys, "n", "sampled", F.least(F.try_divide(F.col("ax") * F.col("ax"), F.col("ss")), F.lit(1.0 - 1e-15)).alias("w"))
    ln, y = F.log("n"), F.log(1 - F.col("w"))
    mu, sd = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3, F.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    n = F.col("n")
    mu2, sd2 = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, F.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    z = F.when(n >= 12, (y - mu) / sd).otherwise((-F.log(F.greatest(-2.273 + 0.459 * n - y, F.lit(1e-12))) - mu2) / sd2)
    out = out.withColumn("z", z).withColumn("q", p_normal(F.col("z")))
    return out.select(*keys, n.cast("long").alias("n"), "w", F.when(F.col("z") > 0, F.col("q") / 2).otherwise(1 - F.col("q") / 2).alias("p"), "sampled")


def shapiro(df: DataFrame, column: str, most: int = 5000) -> DataFrame:
    """One row (n, w, p, sampled) of a column; see :func:`shapiro_by`."""
    return shapiro_by(_values(df, column).withColumn("all", F.lit(0)), ["all"], F.col("x"), most).drop("all")


def normality(rows: DataFrame, keys: list[str], value: str = "value", least: int = 8, choose: int = 5000, alpha: float = 0.05) -> DataFrame:
    """Rows (keys, n, test, statistic, p, normal): Shapiro-Wilk below ``choose`` values, else D'Agostino's K2; groups of ``least`` values."""
    from tidewell.operators.series import dagostino

    v = rows.select(*keys, name(value).cast("double").alias("value")).filter("value IS NOT NULL")
    v = v.join(v.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_n")), keys).filter(F.col("rows_n") >= least)
    short = shapiro_by(v.filter(F.col("rows_n") < choose), keys, F.col("value"), choose).select(
        *keys, "n", F.lit("shapiro").alias("test"), F.col("w").alias("statistic"), "p"
    )
    long = dagostino(v.filter(F.col("rows_n") >= choose), keys).select(*keys, "n", F.lit("dagostino").alias("test"), F.col("k2").alias("statistic"), "p")
    return short.unionByName(long).withColumn("normal", F.col("p") > alpha)


def normality_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """:func:`normality` of each numeric column of a table (rows: column_name, ...)."""
    columns = columns or numeric_columns(df)
    items = F.array(*(F.struct(F.lit(c).alias("column_name"), name(c).cast("double").alias("value")) for c in columns))
    return normality(df.select(F.explode(items).alias("i")).select("i.*"), ["column_name"])


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    return chi2_test(df, a, b)


def anova(df: DataFrame, column: str, group: str) -> DataFrame:
    """One row (groups, n, f, p) over all groups."""
    return mixed_matrix(df, [column], [group], least=1).select("groups", "n", "f", "p")


def welch(df: DataFrame, column: str, group: str, a: str, b: str) -> DataFrame:
    """One row (n_a, n_b, mean_a, mean_b, t, dof, p) between two named groups of two rows or more."""
    x, g = number(name(column)), name(group).cast("string")
    parts = []
    for k, v in (("a", a), ("b", b)):
        own = F.when(g == v, x)
        parts += [F.count(own).alias(f"n_{k}"), F.avg(own).alias(f"mean_{k}"), F.var_samp(own).alias(f"v_{k}")]
    s = df.agg(*parts).filter("n_a >= 2 AND n_b >= 2")
    ea, eb = F.expr("v_a / n_a"), F.expr("v_b / n_b")
    dof = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1))
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(ea + eb))
    return s.select("n_a", "n_b", "mean_a", "mean_b", t.alias("t"), dof.alias("dof")).withColumn("p", p_t(F.col("t"), F.col("dof")))


def _two_counts(df: DataFrame, column: str, group: str, a: str, b: str) -> DataFrame:
    """Rows (value, na, nb): how often each value occurs in the two groups."""
    x, g = number(name(column)), name(group).cast("string")
    rows = df.select(x.alias("value"), g.alias("g")).filter(F.col("value").isNotNull() & F.col("g").isin(a, b))
    return rows.groupBy("value").agg(F.count_if(F.col("g") == a).alias("na"), F.count_if(F.col("g") == b).alias("nb"))


def mann_whitney(df: DataFrame, column: str, group: str, a: str, b: str) -> DataFrame:
    """One row (n_a, n_b, u, z, p): two-sided, tie-corrected, with continuity; u belongs to a."""
    counts = _two_counts(df, column, group, a, b).withColumn("n", F.col("na") + F.col("nb"))
    r = running_before(counts, "value", ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    t = F.col("n").cast("double")
    s = r.agg(
        F.sum("na").cast("double").alias("n_a"), F.sum("nb").cast("double").alias("n_b"), F.sum(F.col("na") * F.col("rank")).alias("ra"),
        F.sum(t * t * t - t).alias("ties")
    ).filter("n_a > 0 AND n_b > 0")
    s = s.withColumn("u", F.expr("ra - n_a * (n_a + 1) / 2")).withColumn("n", F.expr("n_a + n_b"))
    sd = F.sqrt(F.expr("n_a * n_b / 12 * ((n + 1) - ties / (n * (n - 1)))"))
    z = F.try_divide(F.expr("greatest(u, n_a * n_b - u) - n_a * n_b / 2 - 0.5"), sd)
    return s.select(
        F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), "u", z.alias("z")
    ).withColumn("p", F.least(p_normal(F.greatest("z", F.lit(0.0))), F.lit(1.0)))


def kolmogorov_smirnov(df: DataFrame, column: str, group: str, a: str, b: str) -> DataFrame:
    """One row (n_a, n_b, d, p) of the two-sample test (asymptotic p)."""
    counts = _two_counts(df, column, group, a, b)
    total = counts.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b")).filter("n_a > 0 AND n_b > 0")
    r = running_before(counts, "value", ["na", "nb"]).crossJoin(F.broadcast(total))
    gap = F.abs((F.col("before_na") + F.col("na")) / F.col("n_a") - (F.col("before_nb") + F.col("nb")) / F.col("n_b"))
    out = r.groupBy("n_a", "n_b").agg(F.max(gap).alias("d"))
    return out.withColumn("p", p_kolmogorov(F.col("d") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))))


def verdict(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull(), "not enough data").when(p < alpha, "significant").otherwise("not significant")


TESTS = {"shapiro": shapiro, "chi2": chi2, "anova": anova, "ttest_ind": welch, "mannwhitney": mann_whitney, "ks_2samp": kolmogorov_smirnov}


def run_test(df: DataFrame, test: str, *columns: str) -> DataFrame:
    """Run a named test and add the verdict."""
    out = TESTS[test](df, *columns)
    return out.withColumn("verdict", verdict(F.col("p")))

