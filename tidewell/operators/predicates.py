"""One predicate compiler for row filters, transform filters and named segments.

A condition is {"column", "operator", "value"}; conditions are ANDed. The three
vocabularies (words, symbols, short forms) are all accepted; an unknown operator
is an error. Inequality keeps null rows, all other comparisons drop them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.cleaning import is_numeric, name, number

ALIASES = {
    "==": "equals", "=": "equals", "eq": "equals", "!=": "not_equals", "neq": "not_equals", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte",
    "startswith": "starts_with", "endswith": "ends_with",
}
COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def condition(column: str, operator: str, value: object = None) -> Column:
    """One condition on the value's text (equality, patterns) or number (order)."""
    c, op = name(column), ALIASES.get(operator, operator)
    text = c.cast("string")
    if op == "equals":
        return text.eqNullSafe(F.lit(str(value)))
    if op == "not_equals":
        return ~text.eqNullSafe(F.lit(str(value)))
    if op in COMPARE:
        return F.coalesce(COMPARE[op](number(c), F.lit(float(value))), F.lit(False))
    if op == "contains":
        return F.coalesce(text.rlike(str(value)), F.lit(False))
    if op == "not_contains":
        return ~F.coalesce(text.rlike(str(value)), F.lit(False))
    if op == "starts_with":
        return F.coalesce(text.startswith(str(value)), F.lit(False))
    if op == "ends_with":
        return F.coalesce(text.endswith(str(value)), F.lit(False))
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    raise ValueError(f"unknown operator {operator!r}")


def typed_condition(df: DataFrame, column: str, operator: str, value: object = None) -> Column:
    """Like :func:`condition`, but compares in the column's own type (transform filters)."""
    c, op = name(column), ALIASES.get(operator, operator)
    if op not in ("equals", "not_equals", *COMPARE):
        return condition(column, operator, value)
    v = F.lit(float(value)) if is_numeric(df, column) else F.lit(value).cast(df.schema[column].dataType)
    c = c.cast("double") if is_numeric(df, column) else c
    if op == "equals":
        return F.coalesce(c == v, F.lit(False))
    if op == "not_equals":
        return ~c.eqNullSafe(v)
    return F.coalesce(COMPARE[op](c, v), F.lit(False))


def all_of(df: DataFrame, filters: list[dict]) -> Column:
    """Conditions on columns that exist, ANDed; those on unknown columns don't count."""
    known = [condition(f["column"], f["operator"], f.get("value")) for f in filters if f["column"] in df.columns]
    return reduce(lambda a, b: a & b, known, F.lit(True))


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    return df.filter(all_of(df, filters))


def preview_counts(df: DataFrame, filters: list[dict]) -> DataFrame:
    """One row (total_matching, total_rows), from one pass."""
    return df.agg(F.count_if(all_of(df, filters)).alias("total_matching"), F.count(F.lit(1)).alias("total_rows"))


def filter_preview(df: DataFrame, filters: list[dict], limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first matching rows, and the counts."""
    return apply_filters(df, filters).limit(limit), preview_counts(df, filters)


def segment(df: DataFrame, segment_name: str, filters: list[dict]) -> DataFrame:
    """Register a named segment as a temporary view and return it."""
    out = apply_filters(df, filters)
    out.createOrReplaceTempView(segment_name)
    return out


def visible(catalog: DataFrame, workspace: str, global_owner: str, members: DataFrame | None = None, search: str | None = None, limit: int = 50) -> DataFrame:
    """Datasets of a workspace or of the global owner, optionally by name, newest names first."""
    seen = catalog.filter((F.col("workspace") == workspace) | (F.col("owner") == global_owner))
    if members is not None:
        seen = seen.join(members.select("workspace").distinct(), "workspace", "left_semi")
    if search is not None:
        seen = seen.filter(F.col("name").ilike(f"%{search}%"))
    return seen.orderBy("name").limit(limit)
