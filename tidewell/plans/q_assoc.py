"""Queries of groups H (association), I (tests) and J (outliers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import assoc as A
from tidewell.operators import outliers as U
from tidewell.operators import tests_stat as S

from .fixtures import O, orders, t
from .registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_PEARSON = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for a, b in A.numeric_pairs(NUM)
)


@query("h01_pearson", _PEARSON)
def h01(spark, d):
    return _r(A.pearson(t(spark, d, "lineitem"), NUM), 6, "r")


@query("g13_correlation_heatmap", f"{O}SELECT 'price' AS column_a, 'o_orderkey' AS column_b, round(corr(price, o_orderkey), 6) AS r, count(price) AS n FROM o")
def g13(spark, d):
    return _r(A.pearson(orders(spark, d), ["price", "o_orderkey"]), 6, "r")


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(
    "h02_spearman",
    f"WITH r AS (SELECT {_RANK.format('l_quantity')} AS a, {_RANK.format('l_extendedprice')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM r"
)
def h02(spark, d):
    return _r(A.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 6, "r")


_KEN = "WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(u.n * v.n * sign(v.y - u.y)) AS s FROM c u JOIN c v ON u.x < v.x), tx AS (SELECT sum(t * (t - 1) / 2) AS tx FROM (SELECT sum(n) AS t FROM c GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2) AS ty FROM (SELECT sum(n) AS t FROM c GROUP BY y)), k AS (SELECT sum(n) AS n FROM c)"


@query("h03_kendall", f"{_KEN} SELECT round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau, CAST(n AS BIGINT) AS n FROM s, tx, ty, k")
def h03(spark, d):
    return _r(A.kendall(t(spark, d, "lineitem"), "l_quantity", "l_discount"), 6, "tau").drop("z")


@query("h04_correlation_p")
def h04(spark, d):
    return A.correlation_p(A.pearson(t(spark, d, "lineitem"), NUM))


@query("h05_vif")
def h05(spark, d):
    return A.vif(t(spark, d, "lineitem").withColumn("twice", 2 * F.col("l_quantity") + F.col("l_tax")), [*NUM, "twice"])


_CT = "WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM c), g AS (SELECT any_value(n) AS n, count(DISTINCT a) AS k, count(DISTINCT b) AS l, any_value(n) * (sum(o * o / (ra * cb)) - 1) AS chi2, sum(-o / n * log2(ra / n)) AS ha, sum(-o / n * log2(o / cb)) AS hab FROM m)"
_CTL = _CT.format(a="l_returnflag", b="l_linestatus", t="lineitem")
_PHI = "greatest(0, chi2 / n - (k - 1) * (l - 1) / (n - 1))"
_LOW = "least(k - (k - 1) * (k - 1) / (n - 1), l - (l - 1) * (l - 1) / (n - 1)) - 1"


@query(
    "h06_cramers_v",
    f"{_CTL} SELECT CAST(n AS BIGINT) AS n, round(chi2, 3) AS chi2, CAST((k - 1) * (l - 1) AS BIGINT) AS dof, round(sqrt({_PHI} / ({_LOW})), 6) AS cramers_v FROM g"
)
def h06(spark, d):
    return _r(_r(A.categorical_matrix(t(spark, d, "lineitem"), CAT), 6, "cramers_v"), 3, "chi2").select("n", "chi2", "dof", "cramers_v")


@query("h07_theils_u", f"{_CTL} SELECT round((ha - hab) / ha, 6) AS theils_u FROM g")
def h07(spark, d):
    return _r(A.categorical_matrix(t(spark, d, "lineitem"), CAT), 6, "theils_u").select("theils_u")


# with two degrees of freedom the tail of chi-square is exp(-x / 2)
@query(
    "h08_chi2_p",
    f"{_CTL} SELECT CAST(n AS BIGINT) AS n, round(chi2, 3) AS chi2, CAST((k - 1) * (l - 1) AS BIGINT) AS dof, round(exp(-chi2 / 2), 6) AS p FROM g"
)
def h08(spark, d):
    return _r(_r(A.chi2_test(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 3, "chi2"), 6, "p")


@query("h09_categorical_matrix", " UNION ALL ".join(f"SELECT * FROM ({_CT.format(a=a, b=b, t='customer_orders')} SELECT '{a}' AS column_a, '{b}' AS column_b, CAST(n AS BIGINT) AS n, round(chi2, 3) AS chi2, CAST((k - 1) * (l - 1) AS BIGINT) AS dof FROM g)".replace(
    "customer_orders", "(SELECT c_mktsegment, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"
) for a, b in A.numeric_pairs(["c_mktsegment", "o_orderstatus", "o_orderpriority"])))
def h09(spark, d):
    df = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _r(A.categorical_matrix(df, ["c_mktsegment", "o_orderstatus", "o_orderpriority"]), 3, "chi2").select("column_a", "column_b", "n", "chi2", "dof")


def _eta(num, cat, src):
    return f"SELECT '{num}' AS numeric, '{cat}' AS category, sum(n)::BIGINT AS n, count(*) AS groups, round(sum(n * power(m - am, 2)) / any_value(sst), 6) AS eta2, round((sum(n * power(m - am, 2)) / (count(*) - 1)) / ((sum(v)) / (sum(n) - count(*))), 4) AS f FROM (SELECT {cat}, count({num}) AS n, avg({num}) AS m, var_pop({num}) * count({num}) AS v FROM {src} WHERE {num} IS NOT NULL AND {cat} IS NOT NULL GROUP BY 1), (SELECT avg({num}) AS am, var_pop({num}) * count({num}) AS sst FROM {src} WHERE {num} IS NOT NULL AND {cat} IS NOT NULL)"


@query("h10_eta_squared", f"{O}SELECT numeric, category, eta2 FROM ({_eta('price', 'prio', 'o')})")
def h10(spark, d):
    return _r(A.mixed_matrix(orders(spark, d), ["price"], ["prio"]), 6, "eta2").select("numeric", "category", "eta2")


@query("h11_anova_f", f"{O}SELECT n, groups, f FROM ({_eta('price', 'prio', 'o')})")
def h11(spark, d):
    return _r(A.mixed_matrix(orders(spark, d), ["price"], ["prio"]), 4, "f").select("n", "groups", "f")


@query("h12_point_biserial", "SELECT 'O' AS level, round(corr(l_extendedprice, (l_linestatus = 'O')::INT), 6) AS r FROM lineitem")
def h12(spark, d):
    return _r(A.point_biserial(t(spark, d, "lineitem"), "l_extendedprice", "l_linestatus"), 6, "r")


_RB = f"WITH r AS (SELECT l_linestatus AS c, {_RANK.format('l_quantity')} AS k FROM lineitem), g AS (SELECT sum(k) FILTER (WHERE c = 'F') - count(*) FILTER (WHERE c = 'F') * (count(*) FILTER (WHERE c = 'F') + 1) / 2 AS u, count(*) FILTER (WHERE c = 'F') AS n1, count(*) FILTER (WHERE c = 'O') AS n2 FROM r)"


@query(
    "h13_rank_biserial",
    f"{_RB} SELECT 'F' AS level_1, 'O' AS level_2, round(CAST(u AS DOUBLE), 3) AS u, round(1 - 2 * u / (n1::DOUBLE * n2), 6) AS r FROM g"
)
def h13(spark, d):
    return _r(_r(A.rank_biserial(t(spark, d, "lineitem"), "l_quantity", "l_linestatus"), 6, "r"), 3, "u")


@query("h14_mixed_matrix", " UNION ALL ".join(_eta(n, c, "lineitem") for n in ("l_quantity", "l_extendedprice") for c in CAT))
def h14(spark, d):
    return _r(_r(A.mixed_matrix(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], CAT), 6, "eta2"), 4, "f").drop("p")


@query("h15_strongest_pairs", f"SELECT * FROM ({_PEARSON}) ORDER BY abs(r) DESC LIMIT 2")
def h15(spark, d):
    return _r(A.strongest(A.pearson(t(spark, d, "lineitem"), NUM), "r", 2), 6, "r")


@query(
    "h16_column_roles",
    f"{O}SELECT 'o_orderkey' AS column_name, 'numeric' AS role, count(DISTINCT o_orderkey) AS distinct_n FROM o UNION ALL SELECT 'prio', 'categorical', count(DISTINCT prio) FROM o UNION ALL SELECT 'o_orderdate', 'datetime', count(DISTINCT o_orderdate) FROM o UNION ALL SELECT 'nothing', 'empty', 0"
)
def h16(spark, d):
    return A.column_roles(orders(spark, d).select("o_orderkey", "prio", "o_orderdate", F.lit(None).cast("double").alias("nothing")))


@query(
    "h17_insights",
    "SELECT 'correlation' AS kind, printf('l_quantity and twice: r = %.2f', corr(l_quantity, 2 * l_quantity + l_tax)) AS message, 'critical' AS severity FROM lineitem"
)
def h17(spark, d):
    df = t(spark, d, "lineitem").withColumn("twice", 2 * F.col("l_quantity") + F.col("l_tax"))
    return A.insights(numeric=A.pearson(df, ["l_quantity", "l_discount", "twice"]))


@query("h18_method_groups")
def h18(spark, d):
    return A.correlations(t(spark, d, "lineitem").select(*NUM, *CAT), ("mixed",))["mixed"]


@query("i01_shapiro")
def i01(spark, d):
    return S.run_test(t(spark, d, "orders"), "shapiro", "o_totalprice")


@query("g16_normality_table")
def g16(spark, d):
    return S.normality_table(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"))


@query(
    "i08_verdict",
    "SELECT n_a, n_b, CASE WHEN abs((ma - mb) / sqrt(va / n_a + vb / n_b)) > 1.96 THEN 'significant' ELSE 'not significant' END AS verdict FROM (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_b, avg(l_shipped) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_shipped) FILTER (WHERE l_returnflag = 'N') AS mb, var_samp(l_shipped) FILTER (WHERE l_returnflag = 'A') AS va, var_samp(l_shipped) FILTER (WHERE l_returnflag = 'N') AS vb FROM (SELECT l_returnflag, epoch(CAST(l_shipdate AS TIMESTAMP)) / 86400 AS l_shipped FROM lineitem))"
)
def i08(spark, d):
    df = t(spark, d, "lineitem").selectExpr("l_returnflag", "CAST(CAST(l_shipdate AS TIMESTAMP) AS DOUBLE) / 86400 AS l_shipped")
    return S.run_test(df, "ttest_ind", "l_shipped", "l_returnflag", "A", "N").select("n_a", "n_b", "verdict")


@query("i02_chi2", f"{_CTL} SELECT CAST(n AS BIGINT) AS n, round(chi2, 3) AS chi2, CAST((k - 1) * (l - 1) AS BIGINT) AS dof FROM g")
def i02(spark, d):
    return _r(S.chi2(t(spark, d, "lineitem"), *CAT), 3, "chi2").drop("p")


@query("i03_anova", f"SELECT n, groups, f FROM ({_eta('o_totalprice', 'o_orderpriority', 'orders')})")
def i03(spark, d):
    return _r(S.anova(t(spark, d, "orders"), "o_totalprice", "o_orderpriority"), 4, "f").select("n", "groups", "f")


@query(
    "i04_welch",
    "SELECT na AS n_a, nb AS n_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round(power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)), 4) AS dof FROM (SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS na, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS nb, avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS ma, avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS mb, var_samp(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS va, var_samp(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS vb FROM orders)"
)
def i04(spark, d):
    return _r(_r(S.welch(t(spark, d, "orders"), "o_totalprice", "o_orderpriority", "1-URGENT", "5-LOW"), 6, "t"), 4, "dof").select("n_a", "n_b", "t", "dof")


_MW = f"WITH x AS (SELECT l_quantity AS v, l_returnflag AS c FROM lineitem WHERE l_returnflag IN ('A', 'N')), r AS (SELECT c, {_RANK.format('v')} AS k FROM x)"


@query(
    "i05_mann_whitney",
    f"{_MW} SELECT count(*) FILTER (WHERE c = 'A') AS n_a, count(*) FILTER (WHERE c = 'N') AS n_b, round(CAST(sum(k) FILTER (WHERE c = 'A') AS DOUBLE) - count(*) FILTER (WHERE c = 'A') * (count(*) FILTER (WHERE c = 'A') + 1) / 2, 3) AS u FROM r"
)
def i05(spark, d):
    return _r(S.mann_whitney(t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "A", "N"), 3, "u").select("n_a", "n_b", "u")


@query(
    "i06_kolmogorov_smirnov",
    "WITH x AS (SELECT o_totalprice AS v, o_orderstatus AS c FROM orders WHERE o_orderstatus IN ('F', 'O')), k AS (SELECT count(*) FILTER (WHERE c = 'F') AS na, count(*) FILTER (WHERE c = 'O') AS nb FROM x), r AS (SELECT v, sum(count(*) FILTER (WHERE c = 'F')) OVER (ORDER BY v) AS a, sum(count(*) FILTER (WHERE c = 'O')) OVER (ORDER BY v) AS b FROM x GROUP BY v) SELECT na AS n_a, nb AS n_b, round(max(abs(a / na - b / nb)), 6) AS d FROM r, k GROUP BY 1, 2"
)
def i06(spark, d):
    return _r(S.kolmogorov_smirnov(t(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O"), 6, "d").drop("p")


@query("i07_numeric_coercion", f"{O}SELECT count(TRY_CAST(code AS DOUBLE)) AS n, round(avg(TRY_CAST(code AS DOUBLE)), 4) AS mean FROM o")
def i07(spark, d):
    return S._values(orders(spark, d), "code").agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"))


_SPIKED = "(SELECT CASE WHEN l_orderkey % 997 = 0 AND l_linenumber = 1 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price, l_quantity AS qty FROM lineitem)"


def _spiked(spark, d):
    return t(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 997 = 0 AND l_linenumber = 1 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price", "l_quantity AS qty",
        "l_orderkey", "l_linenumber"
    )


def _fence_sql(c):
    return f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, round(100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*), 4) AS pct, round(any_value(q1 - 1.5 * (q3 - q1)), 3) AS lower, round(any_value(q3 + 1.5 * (q3 - q1)), 3) AS upper FROM {_SPIKED}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {_SPIKED})"


_FENCES = _fence_sql("price") + " UNION ALL " + _fence_sql("qty")


@query("j01_fences", _FENCES)
def j01(spark, d):
    return _r(_r(U.fences(_spiked(spark, d), ["price", "qty"]), 4, "pct"), 3, "lower", "upper")


@query("g17_outlier_summary", f"SELECT column_name, outliers, pct FROM ({_FENCES})")
def g17(spark, d):
    return _r(U.outlier_summary(_spiked(spark, d), ["price", "qty"]), 4, "pct").select("column_name", "outliers", "pct")


@query(
    "j02_z_scores",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE abs({c} - m) > 3 * s) AS outliers, round(any_value(m), 3) AS mean, round(any_value(sd), 3) AS std FROM {_SPIKED}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s, stddev_samp({c}) AS sd FROM {_SPIKED})" for c in ("price", "qty"))
)
def j02(spark, d):
    return _r(U.z_scores(_spiked(spark, d), ["price", "qty"]), 3, "mean", "std").drop("pct")


@query("j03_isolation_forest")
def j03(spark, d):
    out = U.isolation_forest(_spiked(spark, d), ["price", "qty"], ["l_orderkey", "l_linenumber"])
    return out.groupBy("outlier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("score"))


_DB = "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, avg(k) AS mk, stddev_pop(k) AS sk FROM (SELECT c_acctbal, c_custkey * c_custkey % 1009 AS k FROM customer)), z AS (SELECT c_custkey, (c_acctbal - m) / s AS x, (c_custkey * c_custkey % 1009 - mk) / sk AS y FROM customer, s), n AS (SELECT a.c_custkey, count(*) AS neighbours FROM z a JOIN z b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.0064 GROUP BY 1), core AS (SELECT z.* FROM z JOIN n USING (c_custkey) WHERE neighbours >= 5)"


@query(
    "j04_density_noise",
    f"{_DB} SELECT n.c_custkey, neighbours, NOT EXISTS (SELECT 1 FROM core c, z WHERE z.c_custkey = n.c_custkey AND power(z.x - c.x, 2) + power(z.y - c.y, 2) <= 0.0064) AS noise FROM n"
)
def j04(spark, d):
    df = t(spark, d, "customer").selectExpr("c_custkey", "c_acctbal", "c_custkey * c_custkey % 1009 AS k")
    return U.density_noise(df, ["c_acctbal", "k"], "c_custkey", eps=0.08, counts=True).select("c_custkey", "neighbours", "noise")


@query(
    "j05_outlier_rows",
    f"SELECT count(*) AS outlier_rows FROM {_SPIKED}, (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(qty, 0.25) AS c, quantile_cont(qty, 0.75) AS e FROM {_SPIKED}) WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a) OR qty < c - 1.5 * (e - c) OR qty > e + 1.5 * (e - c)"
)
def j05(spark, d):
    return U.outlier_rows(_spiked(spark, d), ["price", "qty"])[1]
