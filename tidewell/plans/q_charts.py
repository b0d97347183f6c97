"""Queries of group G (chart data)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import charts as C

from .fixtures import O, orders, t
from .registry import query


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _hist(name, k_sql, rule):
    @query(
        name,
        f"{O.rstrip()}, s AS (SELECT min(price) AS lo, max(price) AS hi, count(price) AS total FROM o), p AS (SELECT lo, CAST({k_sql} AS INTEGER) AS k, (hi - lo) / CAST({k_sql} AS INTEGER) AS w FROM s), c AS (SELECT CAST(least(floor((price - lo) / w), k - 1) AS INTEGER) AS bin, count(*) AS n FROM o, p WHERE price IS NOT NULL GROUP BY 1), g AS (SELECT CAST(unnest(range(k)) AS INTEGER) AS bin, lo, w FROM p) SELECT g.bin, round(lo + g.bin * w, 4) AS lo, round(lo + (g.bin + 1) * w, 4) AS hi, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.bin = c.bin"
    )
    def run(spark, d):
        return _r(C.histogram(orders(spark, d), "price", rule=rule), 4, "lo", "hi")


_hist("g01_histogram_sqrt", "least(greatest(floor(sqrt(total)), 10), 50)", C.SQRT)
_hist("g02_histogram_sturges", "least(greatest(ceil(log2(total)) + 1, 5), 50)", C.STURGES)


@query(
    "g03_density",
    "WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS total, stddev_samp(l_quantity) * power(count(*), -0.2) AS h FROM lineitem), v AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT CAST(unnest(range(200)) AS INTEGER) AS i, * FROM s) SELECT i, round(lo + i * (hi - lo) / 199, 6) AS x, round(sum(n * exp(-0.5 * power((lo + i * (hi - lo) / 199 - v) / h, 2))) / (any_value(total) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM g, v GROUP BY i, lo, hi"
)
def g03(spark, d):
    return _r(C.density(t(spark, d, "lineitem"), "l_quantity"), 6, "x", "density")


_BOX = "SELECT {g} round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3, count(*) AS n, round(avg(x), 3) AS mean, min(x) AS min, max(x) AS max, min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS low, max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM ({src}) {grp}"
_B = ["q1", "median", "q3"]


def _box(df):
    return _r(_r(df, 4, *_B), 3, "mean")


_SPIKE = "SELECT l_returnflag, CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS x FROM lineitem"


def _spiked(spark, d):
    return t(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_returnflag", "l_quantity", "CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS x"
    )


@query("g04_box", _BOX.format(
    g="",
    src=f"SELECT x, quantile_cont(x, 0.25) OVER () AS q1, quantile_cont(x, 0.5) OVER () AS med, quantile_cont(x, 0.75) OVER () AS q3 FROM ({_SPIKE})",
    grp=""
))
def g04(spark, d):
    return _box(C.boxes(_spiked(spark, d), "x"))


@query(
    "g05_box_outliers",
    f"SELECT x FROM (SELECT x, quantile_cont(x, 0.25) OVER () AS q1, quantile_cont(x, 0.75) OVER () AS q3 FROM ({_SPIKE})) WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) ORDER BY x LIMIT 100"
)
def g05(spark, d):
    return C.box_outliers(_spiked(spark, d), "x", 100)


@query(
    "g06_qq_positions",
    "WITH c AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY value) - n + (n + 1) / 2 AS i, (SELECT count(*) FROM lineitem) AS total FROM c) SELECT value, n, round(CASE WHEN i >= total THEN power(0.5, 1 / total) WHEN i <= 1 THEN 1 - power(0.5, 1 / total) ELSE (i - 0.3175) / (total + 0.365) END, 6) AS position FROM r"
)
def g06(spark, d):
    return _r(C.qq_plot(t(spark, d, "lineitem"), "l_quantity"), 6, "position").drop("quantile")


@query("g07_ecdf", "SELECT DISTINCT o_totalprice AS value, round(cume_dist() OVER (ORDER BY o_totalprice), 6) AS p FROM orders")
def g07(spark, d):
    return _r(C.ecdf(t(spark, d, "orders"), "o_totalprice"), 6, "p")


_BARS = "SELECT rank, value, n, round(100.0 * n / t, 4) AS pct, round(100.0 * sum(n) OVER (ORDER BY rank) / t, 4) AS cumulative_pct FROM (SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank, sum(count(*)) OVER () AS t FROM part GROUP BY p_brand) WHERE rank <= 20"


@query("g08_bars", f"SELECT rank, value, n, pct FROM ({_BARS})")
def g08(spark, d):
    return _r(C.bars(t(spark, d, "part"), "p_brand"), 4, "pct").drop("cumulative_pct")


@query("g08_others", f"SELECT (SELECT count(*) FROM part) - CAST(sum(n) AS BIGINT) AS other_count FROM ({_BARS})")
def g08b(spark, d):
    return C.others(t(spark, d, "part"), "p_brand")


@query(
    "g09_pie",
    "WITH c AS (SELECT event_type AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1) SELECT CASE WHEN r <= 3 THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1"
)
def g09(spark, d):
    return C.pie(t(spark, d, "events"), "event_type", 3)


@query("g10_pareto", _BARS)
def g10(spark, d):
    return _r(C.bars(t(spark, d, "part"), "p_brand"), 4, "pct", "cumulative_pct")


@query("g11_per_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def g11(spark, d):
    return C.counts_over_time(t(spark, d, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query(
    "g11_per_week",
    "WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS day, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS day FROM w) SELECT CAST(g.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM g LEFT JOIN w ON g.day = w.day"
)
def g11b(spark, d):
    return C.counts_over_time(t(spark, d, "orders"), "o_orderdate").withColumn("day", F.col("day").cast("string"))


@query(
    "g12_seasonality",
    "SELECT 'hour' AS unit, CAST(hour(ts) AS INTEGER) AS part, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'weekday', CAST(isodow(ts) - 1 AS INTEGER), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'month', CAST(month(ts) AS INTEGER), count(*) FROM events GROUP BY 2"
)
def g12(spark, d):
    return C.seasonality(t(spark, d, "events"), "ts")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]
)


@query("g14_top_pairs", f"SELECT column_a, column_b, round(r, 6) AS r FROM ({_PAIRS.replace('l_extendedprice', 'l_suppkey')}) ORDER BY abs(r) DESC LIMIT 3")
def g14(spark, d):
    return _r(C.top_pairs(t(spark, d, "lineitem"), 3, ["l_quantity", "l_suppkey", "l_discount", "l_tax"]), 6, "r")


@query("g15_auto_grouped_box", _BOX.format(
    g="o_orderstatus,",
    src="SELECT o_orderstatus, o_totalprice AS x, quantile_cont(o_totalprice, 0.25) OVER w AS q1, quantile_cont(o_totalprice, 0.5) OVER w AS med, quantile_cont(o_totalprice, 0.75) OVER w AS q3 FROM orders WINDOW w AS (PARTITION BY o_orderstatus)",
    grp="GROUP BY o_orderstatus"
))
def g15(spark, d):
    df = t(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    value, by = C.pick_grouped_box(df)
    return _box(C.boxes(df, value, [by]))


@query(
    "g18_line_fit",
    "SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem"
)
def g18(spark, d):
    return _r(_r(_r(C.line_fit(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 6, "r", "r2"), 4, "slope"), 3, "intercept")


@query(
    "g19_cross_table",
    "WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10), s AS (SELECT CAST(p_size AS VARCHAR) AS p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT p_brand AS a, CAST(p_size AS VARCHAR) AS b, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM b) AND CAST(p_size AS VARCHAR) IN (SELECT p_size FROM s) GROUP BY 1, 2"
)
def g19(spark, d):
    return C.cross_table(t(spark, d, "part"), "p_brand", "p_size")


@query("g20_grouped_boxes", _BOX.format(
    g="c_mktsegment,",
    src="SELECT c_mktsegment, c_acctbal AS x, quantile_cont(c_acctbal, 0.25) OVER w AS q1, quantile_cont(c_acctbal, 0.5) OVER w AS med, quantile_cont(c_acctbal, 0.75) OVER w AS q3 FROM customer WINDOW w AS (PARTITION BY c_mktsegment)",
    grp="GROUP BY c_mktsegment"
))
def g20(spark, d):
    return _box(C.grouped_boxes(t(spark, d, "customer"), "c_acctbal", "c_mktsegment"))


@query("g21_principal_components")
def g21(spark, d):
    return C.principal_components(t(spark, d, "lineitem"), _NUM, 2)[1]


@query("g22_scatter3d")
def g22(spark, d):
    return C.scatter3d(t(spark, d, "lineitem"), _NUM[:3], ["l_orderkey", "l_linenumber"])


def _sections(found):
    """The tables of a bundle as rows (section, result)."""
    rows = [v.select(F.lit(k).alias("section"), F.to_json(F.struct(*v.columns)).alias("result")) for k, v in found.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("g23_full_analysis")
def g23(spark, d):
    return _sections(C.full_analysis(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")))


@query("g23_column_analysis")
def g23b(spark, d):
    o = t(spark, d, "orders")
    return _sections({f"{c}: {k}": v for c in ("o_totalprice", "o_orderdate", "o_orderpriority") for k, v in C.column_analysis(o, c).items()})
