"""User functions over datasets: DataFrame batches in, DataFrame batches out. No code text is run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.sqlspace import Workspace


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, limit: int | None = 100) -> DataFrame:
    """Apply ``f`` to Arrow batches of the rows; at most ``limit`` rows come back unless it is None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    out = df.mapInPandas(run, schema)
    return out if limit is None else out.limit(limit)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``f`` to each group; a group must fit into a task."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def over_query(workspace: Workspace, sql: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, limit: int | None = 100) -> DataFrame:
    return map_batches(workspace.sql(sql, read_only=True), f, schema, limit)


def python_column(df: DataFrame, new_name: str, inputs: list[str], f: Callable[..., pd.Series], kind: str) -> DataFrame:
    """A column from a vectorised Python function of other columns."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return f(*series)

    return df.withColumn(new_name, run(*inputs))
