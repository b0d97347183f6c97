"""Queries of groups B (filters, projections) and C (cleaning steps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import predicates as P
from tidewell.operators import steps as S

from .fixtures import O, orders, t
from .registry import query

KEY = ["o_orderkey"]


def _filter(name: str, filters: list[dict], where: str) -> None:
    @query(name, f"{O}SELECT o_orderkey, price, prio FROM o WHERE {where}")
    def run(spark, d):
        return P.apply_filters(orders(spark, d), filters).select("o_orderkey", "price", "prio")


_filter(
    "b01_equals", [{"column": "prio", "operator": "equals", "value": "1-URGENT"}, {"column": "nowhere", "operator": "equals", "value": 1}],
    "prio = '1-URGENT'"
)
_filter("b02_not_equals", [{"column": "prio", "operator": "not_equals", "value": "1-URGENT"}], "prio IS DISTINCT FROM '1-URGENT'")
_filter(
    "b03_compare", [{"column": "code", "operator": "gte", "value": 500}, {"column": "price", "operator": "lt", "value": 150000}],
    "TRY_CAST(code AS DOUBLE) >= 500 AND price < 150000"
)
_filter("b04_contains", [{"column": "prio", "operator": "contains", "value": "^[12]-.*(URG|HIGH)"}], "regexp_matches(prio, '^[12]-.*(URG|HIGH)')")
_filter("b05_starts_with", [{"column": "prio", "operator": "starts_with", "value": "3-"}], "starts_with(prio, '3-')")
_filter("b06_is_null", [{"column": "price", "operator": "is_null"}, {"column": "prio", "operator": "is_not_null"}], "price IS NULL AND prio IS NOT NULL")


@query("b07_typed_filter", f"{O}SELECT o_orderkey, price FROM o WHERE price IS DISTINCT FROM 100000.0 AND prio >= '3' ")
def b07(spark, d):
    df = orders(spark, d)
    return df.filter(P.typed_condition(df, "price", "neq", 100000) & P.typed_condition(df, "prio", "gte", "3")).select("o_orderkey", "price")


@query(
    "b08_text_filter",
    f"{O}SELECT o_orderkey, prio FROM o WHERE NOT coalesce(regexp_matches(prio, 'LOW|MED'), false) AND coalesce(ends_with(prio, 'T') OR ends_with(prio, 'H'), false)"
)
def b08(spark, d):
    df = orders(spark, d)
    c = P.typed_condition(df, "prio", "not_contains", "LOW|MED") & (P.typed_condition(df, "prio", "endswith", "T") | P.typed_condition(df, "prio", "endswith", "H"))
    return df.filter(c).select("o_orderkey", "prio")


@query("b09_filter_preview", f"{O}SELECT count(*) FILTER (WHERE price > 100000) AS total_matching, count(*) AS total_rows FROM o")
def b09(spark, d):
    return P.preview_counts(orders(spark, d), [{"column": "price", "operator": "gt", "value": 100000}])


@query("b10_segment", f"{O}SELECT o_orderstatus, count(*) AS n FROM o WHERE price > 50000 AND o_orderstatus = 'F' GROUP BY 1")
def b10(spark, d):
    P.segment(
        orders(spark, d), "big_finished",
        [{"column": "price", "operator": ">", "value": 50000}, {"column": "o_orderstatus", "operator": "==", "value": "F"}]
    )
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM big_finished GROUP BY 1")


def _steps(name: str, steps: list[dict], sql: str) -> None:
    @query(name, O + sql)
    def run(spark, d):
        out, log = S.run_pipeline(orders(spark, d), steps)
        if log:
            raise ValueError(log)
        return out


ALL = "o_orderkey, o_custkey, o_orderstatus, price, o_orderdate, prio, code"
PICK = {"type": "select_columns", "columns": ["o_orderkey", "price", "prio"]}


def _one(name: str, step: dict | list[dict], sql: str, pick: list[str] | None = None) -> None:
    steps = step if isinstance(step, list) else [step]
    _steps(name, [*steps, {"type": "select_columns", "columns": pick or ["o_orderkey", "price"]}], sql)


def _rounded(name: str, steps: list[dict], sql: str, columns: list[str], digits: int = 6) -> None:
    @query(name, O + sql)
    def run(spark, d):
        out, log = S.run_pipeline(orders(spark, d), steps)
        if log:
            raise ValueError(log)
        return out.select("o_orderkey", *(F.round(c, digits).alias(c) for c in columns))


_one(
    "b11_drop_columns", {"type": "drop_columns", "columns": ["o_custkey", "nowhere"]}, "SELECT o_orderkey, o_orderstatus, prio FROM o",
    ["o_orderkey", "o_orderstatus", "prio"]
)
_one(
    "b12_rename_column", {"type": "rename_column", "column": "prio", "new_name": "priority"}, "SELECT o_orderkey, prio AS priority FROM o",
    ["o_orderkey", "priority"]
)
_steps("b13_select_columns", [{"type": "select_columns", "columns": ["price", "o_orderkey"]}], "SELECT price, o_orderkey FROM o")
_one("b14_reorder_columns", [{"type": "reorder_columns", "order": ["prio", "price"]}], "SELECT prio, price, o_orderkey FROM o", ["prio", "price", "o_orderkey"])
_rounded(
    "b15_computed_column", [{"type": "create_column", "new_name": "v", "expression": "sqrt(price) * 2 + ln(o_orderkey + 1)"}],
    "SELECT o_orderkey, round(sqrt(price) * 2 + ln(o_orderkey + 1), 6) AS v FROM o", ["v"]
)


@query(
    "b16_cast",
    f"{O}SELECT o_orderkey, TRY_CAST(code AS BIGINT) AS as_int, TRY_CAST(code AS DOUBLE) AS as_float, CAST(price IS NOT NULL AND price <> 0 AS BOOLEAN) AND price IS NOT NULL AS as_bool FROM o WHERE price IS NOT NULL"
)
def b16(spark, d):
    df = orders(spark, d).filter("price IS NOT NULL").select(
        "o_orderkey", F.col("code").alias("as_int"), F.col("code").alias("as_float"), F.col("price").alias("as_bool")
    )
    for c, k in (("as_int", "int"), ("as_float", "float"), ("as_bool", "bool")):
        df = S.cast_column(df, c, k)
    return df


@query("b17_cast_if_all", f"{O}SELECT o_orderkey, code, CAST(k AS BIGINT) AS k FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS k FROM o)")
def b17(spark, d):
    df = orders(spark, d).select("o_orderkey", "code", F.col("o_custkey").cast("string").alias("k"))
    return S.cast_if_all(S.cast_if_all(df, "code", "bigint"), "k", "bigint")


@query("b18_drop_high_missing", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS a FROM orders")
def b18(spark, d):
    df = t(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS a",
        "CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS b"
    )
    return S.drop_high_missing(df, 50)


_one(
    "b19_drop_null_rows", {"type": "drop_rows_where_null", "columns": ["price", "prio"]},
    "SELECT o_orderkey, price FROM o WHERE price IS NOT NULL AND prio IS NOT NULL"
)


@query("b20_suggested_types", "SELECT * FROM (VALUES ('key', 'float64'), ('day', 'datetime64'), ('prio', NULL)) v(\"column\", suggested_dtype)")
def b20(spark, d):
    df = orders(spark, d).select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "prio")
    return S.suggested_types(df, ["key", "day", "prio"])


@query(
    "b21_visible",
    "SELECT c_name AS name, c_mktsegment AS workspace, CAST(c_nationkey AS VARCHAR) AS owner FROM customer WHERE (c_mktsegment = 'BUILDING' OR CAST(c_nationkey AS VARCHAR) = '7') AND c_name ILIKE '%customer#%1%' ORDER BY c_name LIMIT 50"
)
def b21(spark, d):
    catalog = t(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("workspace"), F.col("c_nationkey").cast("string").alias("owner")
    )
    return P.visible(catalog, "BUILDING", "7", search="customer#%1")


for _k, _e in {"mean": "avg(price)", "median": "quantile_cont(price, 0.5)"}.items():
    _rounded(
        f"c0{1 if _k == 'mean' else 2}_fill_{_k}", [{"type": "fill_missing", "column": "price", "strategy": _k}],
        f"SELECT o_orderkey, round(coalesce(price, (SELECT {_e} FROM o)), 4) AS price FROM o", ["price"], 4
    )
_one(
    "c03_fill_mode", {"type": "fill_missing", "column": "prio", "strategy": "mode"},
    "SELECT o_orderkey, coalesce(prio, (SELECT prio FROM o WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)) AS prio FROM o",
    ["o_orderkey", "prio"]
)
_one(
    "c04_fill_constant", {"type": "fill_missing", "column": "price", "strategy": "constant", "value": -1},
    "SELECT o_orderkey, coalesce(price, -1) AS price FROM o"
)
_one(
    "c05_forward_fill", {"type": "fill_missing", "column": "price", "strategy": "ffill", "order_by": "o_orderkey", "partition_by": ["o_custkey"]},
    "SELECT o_orderkey, last_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM o"
)
_one(
    "c06_backward_fill", {"type": "fill_missing", "column": "price", "strategy": "bfill", "order_by": "o_orderkey", "partition_by": ["o_custkey"]},
    "SELECT o_orderkey, first_value(price IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM o"
)
_rounded(
    "c07_minmax", [{"type": "scale", "column": "price", "method": "minmax"}],
    "SELECT o_orderkey, round((price - (SELECT min(price) FROM o)) / (SELECT max(price) - min(price) FROM o), 6) AS price FROM o", ["price"]
)
_rounded(
    "c08_standardize", [{"type": "scale", "column": "price", "method": "standardize"}],
    "SELECT o_orderkey, round((price - (SELECT avg(price) FROM o)) / (SELECT stddev_samp(price) FROM o), 6) AS price FROM o", ["price"]
)
_rounded(
    "c09_standard_scale", [{"type": "scale", "column": "price", "method": "standard"}],
    "SELECT o_orderkey, round((price - (SELECT avg(price) FROM o)) / (SELECT stddev_pop(price) FROM o), 6) AS price FROM o", ["price"]
)
_rounded(
    "c10_robust_scale", [{"type": "scale", "column": "price", "method": "robust"}],
    "SELECT o_orderkey, round((price - (SELECT quantile_cont(price, 0.5) FROM o)) / (SELECT quantile_cont(price, 0.75) - quantile_cont(price, 0.25) FROM o), 6) AS price FROM o",
    ["price"]
)
_NEG = {"type": "create_column", "new_name": "price", "expression": "price - 100000"}
_rounded(
    "c11_log_in_place", [_NEG, {"type": "log_in_place", "column": "price"}],
    "SELECT o_orderkey, round(CASE WHEN price - 100000 >= 0 THEN ln(1 + (price - 100000)) ELSE price - 100000 END, 6) AS price FROM o", ["price"]
)
_rounded(
    "c12_log_column",
    [{"type": "log_transform", "column": "price", "new_name": "a"}, _NEG, {"type": "log_transform", "column": "price", "variant": "log", "new_name": "b"}],
    "SELECT o_orderkey, round(ln(1 + price), 6) AS a, round(ln(CASE WHEN price - 100000 > 1e-9 THEN price - 100000 WHEN price IS NOT NULL THEN 1e-9 END), 6) AS b FROM o",
    ["a", "b"]
)
_rounded(
    "c13_sqrt_column", [_NEG, {"type": "sqrt_transform", "column": "price"}],
    "SELECT o_orderkey, round(sqrt(CASE WHEN price - 100000 > 0 THEN price - 100000 WHEN price IS NOT NULL THEN 0 END), 6) AS price_sqrt FROM o",
    ["price_sqrt"]
)
_one(
    "c14_equal_width_bins", {"type": "bin", "column": "price", "k": 7},
    "SELECT o_orderkey, CAST(CASE WHEN price IS NOT NULL THEN least(greatest(ceil((price - lo) / ((hi - lo) / 7)) - 1, 0), 6) END AS INTEGER) AS price_bin FROM o, (SELECT min(price) AS lo, max(price) AS hi FROM o)",
    ["o_orderkey", "price_bin"]
)
_one(
    "c15_quantile_bins", {"type": "bin", "column": "price", "k": 4, "strategy": "qcut"},
    "SELECT o_orderkey, CAST(CASE WHEN price IS NOT NULL THEN (price > q1)::INT + (price > q2)::INT + (price > q3)::INT END AS INTEGER) AS price_bin FROM o, (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM o)",
    ["o_orderkey", "price_bin"]
)
_one(
    "c16_one_hot", {"type": "one_hot_encode", "column": "o_orderstatus"},
    "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus IS NOT DISTINCT FROM '{v}' AS INTEGER) AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM o",
    ["o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"]
)
_one(
    "c17_label_encode", {"type": "label_encode", "column": "prio"},
    "SELECT o_orderkey, CAST(CASE WHEN prio IS NOT NULL THEN (SELECT count(DISTINCT prio) FROM o p WHERE p.prio < o.prio) END AS INTEGER) AS prio FROM o",
    ["o_orderkey", "prio"]
)
_one(
    "c18_category_codes", {"type": "label_encode", "column": "prio", "null_code": -1},
    "SELECT o_orderkey, CAST(CASE WHEN prio IS NOT NULL THEN (SELECT count(DISTINCT prio) FROM o p WHERE p.prio < o.prio) ELSE -1 END AS INTEGER) AS prio FROM o",
    ["o_orderkey", "prio"]
)
_one(
    "c19_clip", {"type": "clip", "column": "price", "lower": 20000, "upper": 200000},
    "SELECT o_orderkey, CASE WHEN price < 20000 THEN 20000.0 WHEN price > 200000 THEN 200000.0 ELSE price END AS price FROM o"
)
_Q = "(SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM o)"
_SPIKE = {"type": "create_column", "new_name": "price", "expression": "CASE WHEN o_orderkey % 97 = 0 THEN price * 20 ELSE price END"}
_OS = "o2 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN price * 20 ELSE price END AS price FROM o)"


def _spiked(name: str, step: dict, sql: str) -> None:
    @query(name, f"{O.rstrip()}, {_OS} {sql}")
    def run(spark, d):
        out, log = S.run_pipeline(orders(spark, d), [_SPIKE, step])
        if log:
            raise ValueError(log)
        return out.select("o_orderkey", F.round("price", 4).alias("price"))


_Q2 = _Q.replace("FROM o", "FROM o2")
_spiked(
    "c20_cap_outliers_iqr", {"type": "cap_outliers", "column": "price"},
    f"SELECT o_orderkey, round(CASE WHEN price IS NOT NULL THEN least(greatest(price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 4) AS price FROM o2, {_Q2}"
)
_spiked(
    "c21_cap_outliers_percentile", {"type": "cap_outliers", "column": "price", "method": "percentile"},
    f"SELECT o_orderkey, round(CASE WHEN price IS NOT NULL THEN least(greatest(price, q1), q3) END, 4) AS price FROM o2, {_Q2.replace('0.25', '0.01').replace('0.75', '0.99')}"
)
_spiked(
    "c22_drop_outliers_iqr", {"type": "drop_outliers", "column": "price"},
    f"SELECT o_orderkey, round(price, 4) AS price FROM o2, {_Q2} WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
)
_spiked(
    "c23_drop_outliers_zscore", {"type": "drop_outliers", "column": "price", "method": "zscore"},
    "SELECT o_orderkey, round(price, 4) AS price FROM (SELECT *, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM o2)) AS x FROM o2), (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT coalesce(price, (SELECT quantile_cont(price, 0.5) FROM o2)) AS x FROM o2)) WHERE abs((x - m) / s) < 3"
)
_one(
    "c24_drop_duplicates", {"type": "drop_duplicates", "subset": ["o_custkey", "o_orderstatus"], "order_by": ["o_orderdate", "o_orderkey"]},
    "SELECT o_orderkey, price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS n FROM o) WHERE n = 1"
)


@query("c25_sample_rows")
def c25(spark, d):
    return S.sample_rows(orders(spark, d), KEY, fraction=0.1)


@query("c26_sort_rows", f"{O}SELECT o_orderkey, price, row_number() OVER (ORDER BY prio ASC NULLS LAST, price DESC NULLS LAST, o_orderkey ASC) AS n FROM o")
def c26(spark, d):
    from tidewell.operators.ranks import positions

    key = F.expr("struct(prio IS NULL, prio, price IS NULL, -price, o_orderkey)")
    numbered = positions(orders(spark, d), key, "n").withColumn("n", F.col("n") + 1)
    return S.sort_rows(numbered, ["prio", "price", "o_orderkey"], [True, False, True]).select("o_orderkey", "price", "n")


@query(
    "c27_datetime_parts",
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute, CAST(isodow(ts) - 1 AS INTEGER) AS ts_weekday, CAST(quarter(ts) AS INTEGER) AS ts_quarter FROM events"
)
def c27(spark, d):
    parts = ["year", "month", "day", "hour", "minute", "weekday", "quarter"]
    return S.datetime_parts(t(spark, d, "events"), "ts", parts).select("event_id", *(f"ts_{p}" for p in parts))


@query(
    "c28_clean_text",
    "SELECT doc_id, regexp_replace(replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 'the', 'THE'), '[^a-zA-Z0-9\\s]', '', 'g') AS text FROM documents"
)
def c28(spark, d):
    return S.clean_text(t(spark, d, "documents"), "text", strip=True, lower=True, find="the", replace="THE", alphanumeric=True).select("doc_id", "text")


_rounded("c29_pipeline", [
    {"type": "filter_rows", "column": "o_orderstatus", "operator": "neq", "value": "P"},
    {"type": "fill_missing", "column": "price", "strategy": "median"}, {"type": "clip", "column": "price", "upper": 250000},
    {"type": "create_column", "new_name": "k", "expression": "price / 1000"}, {"type": "label_encode", "column": "prio", "null_code": -1}
],
         "SELECT o_orderkey, round(least(coalesce(price, m), 250000) / 1000, 6) AS k FROM (SELECT * FROM o WHERE o_orderstatus <> 'P'), (SELECT quantile_cont(price, 0.5) AS m FROM o WHERE o_orderstatus <> 'P')", ["k"])


@query("c30_preview")
def c30(spark, d):
    return S.preview(orders(spark, d), [{"type": "scale", "column": "price", "method": "minmax"}])[0]


_C31 = [
    {"type": "filter_rows", "column": "price", "operator": "gt", "value": 1000},
    {"type": "label_encode", "column": "o_orderstatus"},
    {"type": "drop_columns", "columns": ["o_orderdate", "code", "o_custkey", "prio"]},
]


@query(
    "c31_step_schema",
    f"{O}SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus, price FROM o WHERE price > 1000"
)
def c31(spark, d):
    """A step list is checked against the closed vocabulary, then run."""
    if wrong := S.check_steps(_C31):
        raise ValueError("; ".join(wrong))
    return S.run_pipeline(orders(spark, d), _C31)[0]
