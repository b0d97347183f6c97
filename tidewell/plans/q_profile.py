"""Queries of groups F (profiles, missing values, quality) and A (sources, catalog) that SQL can say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import assoc, outliers
from tidewell.operators import profile as P

from .fixtures import O, orders, t
from .registry import query

LINE = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


def _profile_sql(table: str, columns: dict[str, tuple[str, str]]) -> str:
    """columns: name -> (Spark type, kind)."""
    parts = []
    for c, (dtype, kind) in columns.items():
        x = f"CAST({c} AS DOUBLE)"
        num = kind == "numeric"
        stats = {
            "min": f"min({x})", "max": f"max({x})", "mean": f"round(avg({x}), 5)", "median": f"round(quantile_cont({x}, 0.5), 6)",
            "std": f"round(stddev_samp({x}), 6)", "skewness": f"round(skewness({x}), 6)", "kurtosis": f"round(kurtosis({x}), 6)"
        }
        semantic = f"CASE WHEN '{kind}' = 'datetime' THEN 'datetime' WHEN count(DISTINCT {c}) <= 1 THEN 'constant' WHEN count(DISTINCT {c}) / count(*) > 0.95 AND count(DISTINCT {c}) > 100 THEN 'id_like' WHEN '{kind}' = 'numeric' THEN 'numeric' WHEN avg(length(CAST({c} AS VARCHAR))) > 50 THEN 'text' ELSE 'categorical' END"
        parts.append(f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, {semantic} AS semantic_type, count(*) AS total, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct, count(DISTINCT {c}) AS distinct_n, round(count(DISTINCT {c}) / count(*) * 100, 4) AS distinct_pct, " + ", ".join(
            f"{e if num else 'CAST(NULL AS DOUBLE)'} AS \"{k}\"" for k, e in stats.items()
        ) + f" FROM {table}")
    return " UNION ALL ".join(parts)


def _rounded(p):
    return p.select(
        "column_name", "dtype", "semantic_type", "total", "missing", F.round("missing_pct", 4).alias("missing_pct"), "distinct_n",
        F.round("distinct_pct", 4).alias("distinct_pct"), "min", "max", *(F.round(c, 5 if c == "mean" else 6).alias(c) for c in P.STATS[2:])
    )


_LINE_SQL = _profile_sql("lineitem", {c: (
    {"l_returnflag": "string", "l_linestatus": "string"}.get(c, "bigint" if "key" in c else "double"), "text" if c in LINE[-2:] else "numeric"
) for c in LINE})


@query("f01_column_profile", _LINE_SQL)
def f01(spark, d):
    return _rounded(P.column_profile(t(spark, d, "lineitem").select(*LINE)))


_MIX = {
    "o_orderkey": ("bigint", "numeric"), "price": ("double", "numeric"), "o_orderdate": ("timestamp_ntz", "datetime"), "prio": ("string", "text"),
    "k": ("int", "numeric")
}
_M = O.rstrip() + ", m AS (SELECT o_orderkey, price, o_orderdate, prio, CAST(1 AS INTEGER) AS k FROM o) "


def _mix(spark, d):
    return orders(spark, d).select("o_orderkey", "price", "o_orderdate", "prio", F.lit(1).alias("k"))


@query("f02_semantic_type", f"{_M}SELECT column_name, semantic_type FROM ({_profile_sql('m', _MIX)})")
def f02(spark, d):
    return P.column_profile(_mix(spark, d)).select("column_name", "semantic_type")


@query("f03_distinct", f"{_M}SELECT column_name, distinct_n, distinct_pct FROM ({_profile_sql('m', _MIX)})")
def f03(spark, d):
    return _rounded(P.column_profile(_mix(spark, d))).select("column_name", "distinct_n", "distinct_pct")


@query("f04_missing", f"{_M}SELECT column_name, missing, missing_pct FROM ({_profile_sql('m', _MIX)})")
def f04(spark, d):
    return _rounded(P.column_profile(_mix(spark, d))).select("column_name", "missing", "missing_pct")


@query("f05_moments", f"{_M}SELECT column_name, \"min\", \"max\", \"mean\", \"median\", \"std\" FROM ({_profile_sql('m', _MIX)}) WHERE \"mean\" IS NOT NULL")
def f05(spark, d):
    return _rounded(P.column_profile(_mix(spark, d))).filter("mean IS NOT NULL").select("column_name", "min", "max", "mean", "median", "std")


@query("f06_skew_kurtosis", "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS s, round(kurtosis(l_extendedprice), 6) AS k FROM lineitem GROUP BY 1")
def f06(spark, d):
    c = F.col("l_extendedprice")
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(P.unbiased_skewness(c), 6).alias("s"), F.round(P.unbiased_kurtosis(c), 6).alias("k"))


def _top_sql(table: str, columns: list[str], k: int) -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 2" for c in columns]
    return f"SELECT column_name, rank, value, n, round(100.0 * n / (SELECT count(*) FROM {table}), 4) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM ({' UNION ALL '.join(parts)})) WHERE rank <= {k}"


@query("f07_top_values", f"{O}{_top_sql('o', ['o_orderstatus', 'prio', 'o_custkey'], 5)}")
def f07(spark, d):
    return P.top_values(orders(spark, d), ["o_orderstatus", "prio", "o_custkey"]).withColumn("pct", F.round("pct", 4))


_DUP = "SELECT o_custkey, o_orderstatus FROM orders"


@query(
    "f08_duplicates",
    f"SELECT count(*) AS total, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DUP}))) AS duplicate_rows, round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DUP})))) / count(*), 4) AS duplicate_pct FROM ({_DUP})"
)
def f08(spark, d):
    return P.duplicates(t(spark, d, "orders").select("o_custkey", "o_orderstatus")).withColumn("duplicate_pct", F.round("duplicate_pct", 4))


@query(
    "f09_memory_estimate",
    "SELECT round((count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority))) / 1048576.0, 6) AS memory_mb FROM orders"
)
def f09(spark, d):
    return P.memory_estimate(t(spark, d, "orders")).select(F.round("memory_mb", 6).alias("memory_mb"))


@query("f10_missing_table", f"{_M}SELECT column_name, missing, missing_pct FROM ({_profile_sql('m', _MIX)}) WHERE missing > 0")
def f10(spark, d):
    return P.missing_table(_mix(spark, d)).withColumn("missing_pct", F.round("missing_pct", 4))


@query(
    "f10_missing_total",
    f"{_M}SELECT count(*) * 5 AS cells, CAST(sum((price IS NULL)::INT + (prio IS NULL)::INT) AS BIGINT) AS missing, round(100.0 * sum((price IS NULL)::INT + (prio IS NULL)::INT) / (count(*) * 5), 4) AS missing_pct FROM m"
)
def f10b(spark, d):
    return P.missing_total(_mix(spark, d)).withColumn("missing_pct", F.round("missing_pct", 4))


_GAPS = "g AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_totalprice > 220000 OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS b FROM orders)"


def _gaps(spark, d):
    return t(spark, d, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_custkey END AS a",
        "CASE WHEN o_totalprice > 220000 OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS b"
    )


@query(
    "f11_missing_together",
    f"WITH {_GAPS} SELECT 'a' AS column_a, 'b' AS column_b, round(corr((a IS NULL)::INT::DOUBLE, (b IS NULL)::INT::DOUBLE), 3) AS r FROM g"
)
def f11(spark, d):
    return P.missing_together(_gaps(spark, d)).withColumn("r", F.round("r", 3))


@query("f12_missing_mechanism", f"""WITH {_GAPS}, r AS (SELECT 'a' AS column_name, 'o_totalprice' AS other, corr((a IS NULL)::INT::DOUBLE, o_totalprice) AS r FROM g UNION ALL SELECT 'a', 'o_orderkey', corr((a IS NULL)::INT::DOUBLE, o_orderkey) FROM g
UNION ALL SELECT 'b', 'o_totalprice', corr((b IS NULL)::INT::DOUBLE, o_totalprice) FROM g UNION ALL SELECT 'b', 'o_orderkey', corr((b IS NULL)::INT::DOUBLE, o_orderkey) FROM g UNION ALL SELECT 'b', 'a', corr((b IS NULL)::INT::DOUBLE, a) FROM g)
SELECT column_name, CASE WHEN count(*) FILTER (WHERE abs(r) > 0.3) > 0 THEN 'MAR' ELSE 'MCAR' END AS mechanism, coalesce(string_agg(other, ',' ORDER BY other) FILTER (WHERE abs(r) > 0.3), '') AS related FROM r GROUP BY 1""")
def f12(spark, d):
    return P.missing_mechanism(_gaps(spark, d))


@query(
    "f13_imputation",
    f"WITH {_GAPS} SELECT 'a' AS column_name, CASE WHEN abs(skewness(a)) > 1 THEN 'median' ELSE 'mean' END AS suggestion FROM g UNION ALL SELECT 'b', CASE WHEN try_cast(min(b) AS DOUBLE) IS NULL THEN 'mode' ELSE 'mean' END FROM g HAVING count(*) > count(b)"
)
def f13(spark, d):
    return P.imputation(_gaps(spark, d))


@query("f14_missing_bar", f"{_M}SELECT column_name, missing FROM ({_profile_sql('m', _MIX)}) WHERE missing > 0 ORDER BY missing DESC")
def f14(spark, d):
    return P.missing_table(_mix(spark, d)).select("column_name", "missing")


@query("f15_quality_score", f"""{_M.rstrip()}, p AS ({_profile_sql('m', _MIX)}), s AS (SELECT CAST(floor(100 - 100.0 * sum(missing) / sum(total)) AS INTEGER) AS completeness, CAST(floor(100 - 100.0 * count(*) FILTER (WHERE semantic_type = 'constant') / count(*)) AS INTEGER) AS consistency, (SELECT CAST(floor(100.0 * (SELECT count(*) FROM (SELECT DISTINCT * FROM m)) / count(*)) AS INTEGER) FROM m) AS uniqueness FROM p)
SELECT completeness, consistency, uniqueness, CAST(floor(0.5 * completeness + 0.25 * consistency + 0.25 * uniqueness) AS INTEGER) AS overall FROM s""")
def f15(spark, d):
    return P.quality_score(_mix(spark, d))


@query("f19_quality_issues", f"""WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS b, 1 AS k, o_totalprice * o_totalprice * o_totalprice * o_totalprice AS c FROM orders)
SELECT * FROM (
  SELECT column_name, CASE WHEN pct > 50 THEN 'missing_critical' WHEN pct > 20 THEN 'missing_moderate' END AS issue, CASE WHEN pct > 50 THEN 0 ELSE 1 END AS severity
  FROM (SELECT 'a' AS column_name, 100.0 * (count(*) - count(a)) / count(*) AS pct FROM q UNION ALL SELECT 'b', 100.0 * (count(*) - count(b)) / count(*) FROM q)
  UNION ALL SELECT 'k', CASE WHEN count(DISTINCT k) <= 1 THEN 'constant' END, 1 FROM q
  UNION ALL SELECT 'a', CASE WHEN abs(skewness(a)) > 2 THEN 'high_skew' END, 2 FROM q
  UNION ALL SELECT 'c', CASE WHEN abs(skewness(c)) > 2 THEN 'high_skew' END, 2 FROM q
) WHERE issue IS NOT NULL""")
def f19(spark, d):
    df = t(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS a",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS b", "1 AS k",
        "o_totalprice * o_totalprice * o_totalprice * o_totalprice AS c"
    )
    return P.quality_issues(df)


@query("f20_column_detail", """WITH s AS (SELECT count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, avg(power((o_totalprice - m) / sd, 3)) AS skewness, avg(power((o_totalprice - m) / sd, 4)) - 3 AS kurtosis, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders))
SELECT n, round(mean, 4) AS mean, round(std, 4) AS std, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis, round(q1, 4) AS q1, round(q3, 4) AS q3, (SELECT count(*) FROM orders WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers FROM s""")
def f20(spark, d):
    out = P.column_detail(t(spark, d, "orders"), "o_totalprice")
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "skewness", "kurtosis", "q1", "q3")), "outliers")


@query(
    "f21_cardinality",
    f"{_M}SELECT column_name, distinct_n, CASE WHEN distinct_n > 0.95 * total THEN 'id_like' WHEN distinct_n <= 1 THEN 'constant' WHEN distinct_n = 2 THEN 'binary' WHEN distinct_n < 10 THEN 'low_cardinality' ELSE 'normal' END AS class FROM ({_profile_sql('m', _MIX)})"
)
def f21(spark, d):
    return P.cardinality(_mix(spark, d))


@query("f22_analysis_batch")
def f22(spark, d):
    done, failed = P.analysis_batch(
        _mix(spark, d),
        {"profile": P.column_profile, "missing": P.missing_table, "quality": P.quality_score, "correlations": assoc.pearson, "outliers": outliers.fences}
    )
    rows = [v.select(F.lit(k).alias("analysis"), F.to_json(F.struct(*v.columns)).alias("result")) for k, v in done.items()]
    rows += [spark.createDataFrame([(k, f"failed: {v}")], "analysis string, result string") for k, v in failed.items()]
    return reduce(DataFrame.unionByName, rows)
