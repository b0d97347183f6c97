"""Inputs of the registered queries: the given tables, and orders with missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Orders with nulls by a rule, the same text for both engines.
ORDERS = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderdate, "
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 1000 AS VARCHAR(20)) END AS code FROM orders"
)
O = f"WITH o AS ({ORDERS}) "


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    """Run SQL over the named tables, given as parameters rather than views."""
    return spark.sql(text.format(**{n: "{" + n + "}" for n in tables}), **{n: t(spark, d, n) for n in tables})


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ORDERS.replace("FROM orders", "FROM {orders}"), orders=t(spark, d, "orders"))
