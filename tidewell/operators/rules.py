"""User-written quality rules, checked in one pass; also usable on streams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import name, number, share

ROW_WISE = ("not_null", "range", "regex", "allowed_values")


def fails(column: str, rule: str, params: dict | None = None) -> Column:
    """Whether a row breaks a rule. ``unique`` needs the whole column, see :func:`check`."""
    c, p = name(column), params or {}
    if rule == "not_null":
        return c.isNull()
    if rule == "range":
        low, high = p.get("min"), p.get("max")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (number(c) < float(low))
        if high is not None:
            bad = bad | (number(c) > float(high))
        return F.coalesce(bad, F.lit(False))
    if rule == "regex":
        return ~F.coalesce(c.cast("string").rlike(f"^(?:{p['pattern']})"), F.lit(False))
    if rule == "allowed_values":
        return c.isNotNull() & ~F.coalesce(c.cast("string").isin(*map(str, p["values"])), F.lit(False))
    raise ValueError(f"unknown rule {rule!r}")


def check(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows (rule_id, column_name, rule_type, fail_count, fail_pct, pass_pct) of all rules.

    Row-wise rules share one aggregate. ``unique`` counts every member of a group of
    equal values (nulls are equal) by grouping, so a value on a third of all rows
    is one partial row per task.
    """
    simple = [(i, r) for i, r in enumerate(rules) if r["rule_type"] != "unique"]
    total = F.count(F.lit(1)).alias("total")
    out = None
    if simple:
        one = df.agg(total, *(F.count_if(fails(r["column_name"], r["rule_type"], r.get("params"))).alias(f"f{i}") for i, r in simple))
        out = one.select("total", F.inline(F.array(*(F.struct(
            F.lit(i).alias("rule_id"), F.lit(r["column_name"]).alias("column_name"), F.lit(r["rule_type"]).alias("rule_type"),
            F.col(f"f{i}").alias("fail_count")
        ) for i, r in simple))))
    for i, r in enumerate(rules):
        if r["rule_type"] == "unique":
            g = df.groupBy(name(r["column_name"])).agg(F.count(F.lit(1)).alias("n"))
            u = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("fail_count"))
            u = u.select("total", F.lit(i).alias("rule_id"), F.lit(r["column_name"]).alias("column_name"), F.lit("unique").alias("rule_type"), "fail_count")
            out = u if out is None else out.unionByName(u)
    pct = F.coalesce(share(F.col("fail_count"), F.col("total")), F.lit(0.0))
    return out.select("rule_id", "column_name", "rule_type", "fail_count", pct.alias("fail_pct"), (100 - pct).alias("pass_pct"))


def pass_rate(results: DataFrame) -> DataFrame:
    return results.agg((F.avg("pass_pct") / 100).alias("overall_pass_rate"))


def failing_rows(df: DataFrame, rule: dict, limit: int = 5) -> DataFrame:
    if rule["rule_type"] == "unique":
        again = df.groupBy(name(rule["column_name"]).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__v")
        return df.join(again, name(rule["column_name"]).eqNullSafe(F.col("__v")), "left_semi").limit(limit)
    return df.filter(fails(rule["column_name"], rule["rule_type"], rule.get("params"))).limit(limit)


def quarantine(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that break a row-wise rule, with the broken rules; works on streams too."""
    broken = F.array_compact(F.array(*(F.when(
        fails(r["column_name"], r["rule_type"], r.get("params")), F.lit(f"{r['column_name']}:{r['rule_type']}")
    ) for r in rules if r["rule_type"] in ROW_WISE)))
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)


def rule_table(spark, rules: list[dict]) -> DataFrame:
    """A rule set as a table (rule_id, column_name, rule_type, params as JSON)."""
    rows = [(i, r["column_name"], r["rule_type"], json.dumps(r.get("params") or {}, sort_keys=True)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, column_name string, rule_type string, params string")


def load_rules(table: DataFrame) -> list[dict]:
    return [{"column_name": r["column_name"], "rule_type": r["rule_type"], "params": json.loads(r["params"])} for r in table.orderBy("rule_id").collect()]


def save_rules(table: DataFrame, path: str, append: bool = False) -> None:
    table.write.mode("append" if append else "overwrite").parquet(path)


def unique_flag(column: str) -> Column:
    """Row-level flag of repeated values, for tables where the rows themselves are wanted."""
    return F.count(F.lit(1)).over(Window.partitionBy(name(column))) > 1
