"""Cleaning and feature steps, and the ordered pipeline that folds them.

Each step takes and returns a DataFrame. Steps that need statistics of the whole
column attach a one-row aggregate by a broadcast cross join, so plans stay
lazy and nothing is collected. Row order is never implied: fills and
duplicate removal take an explicit order key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import is_numeric, name, number
from tidewell.operators.predicates import typed_condition
from tidewell.operators.ranks import exact_quantiles, in_ranges, join_on_value, positions


#: More levels than these don't become columns of their own.
MOST_LEVELS = 1000


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """Every row with the named one-row aggregates beside it."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in stats.items()))))


def with_quantiles(df: DataFrame, c: Column, points: list[float]) -> DataFrame:
    """One row (q): exact quantiles of a column over all rows."""
    return exact_quantiles(df, [], c, points)


def _replace(df: DataFrame, column: str, value: Column, keep: list[str]) -> DataFrame:
    return df.withColumn(column, value).select(*(name(c) for c in keep))


# --- columns -------------------------------------------------------------------


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    if column not in df.columns or new_name in df.columns:
        raise ValueError(f"can't rename {column!r} to {new_name!r}")
    return df.withColumnRenamed(column, new_name)


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(name(c) for c in columns if c in df.columns))


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    first = [c for c in order if c in df.columns]
    return df.select(*(name(c) for c in first), *(name(c) for c in df.columns if c not in first))


def create_column(df: DataFrame, new_name: str, expression: str) -> DataFrame:
    """A column from an SQL expression over the other columns."""
    return df.withColumn(new_name, F.expr(expression))


def cast_column(df: DataFrame, column: str, to_type: str) -> DataFrame:
    """Values that can't be read become null; null stays null."""
    c = name(column)
    casts = {
        "int": lambda: number(c).try_cast("bigint"),
        "float": lambda: number(c),
        "str": lambda: c.cast("string"),
        "datetime": lambda: F.try_to_timestamp(c.cast("string")),
        "bool": lambda: F.when(c.isNull(), None).otherwise(number(c) != 0 if is_numeric(df, column) else F.length(c.cast("string")) > 0),
    }
    return df.withColumn(column, casts[to_type]())


def cast_if_all(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Cast only if no value would be lost; else the column stays as it is."""
    c = name(column)
    tried = c.cast("string").try_cast(dtype)
    lost = df.agg((F.count(c) - F.count(tried)).alias("n")).first()["n"]
    return df if lost else df.withColumn(column, tried)


def drop_high_missing(df: DataFrame, threshold: float = 50) -> DataFrame:
    """Drop columns whose missing share is above the threshold in percent."""
    row = df.agg(*(F.avg(name(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns))).first()
    return df.drop(*(c for i, c in enumerate(df.columns) if (row[i] or 0) * 100 > threshold))


def suggested_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, suggested_dtype): float64, datetime64 or null, from one pass."""
    aggs = []
    for i, k in enumerate(columns):
        c = name(k).cast("string")
        aggs += [F.count(c).alias(f"n{i}"), F.count(c.try_cast("double")).alias(f"f{i}"), F.count(F.try_to_timestamp(c)).alias(f"t{i}")]
    rows = F.array(*(F.struct(F.lit(k).alias("column"), F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i}") == F.col(f"f{i}")), "float64").when(
        (F.col(f"n{i}") > 0) & (F.col(f"n{i}") == F.col(f"t{i}")), "datetime64"
    ).alias("suggested_dtype")) for i, k in enumerate(columns)))
    return df.agg(*aggs).select(F.inline(rows))


# --- missing values --------------------------------------------------------------


def fill(df: DataFrame, column: str, strategy: str, value: object = None, order_by: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Fill nulls: mean, median, mode (smallest on ties), constant, forward, backward.

    Forward and backward fills run along ``order_by`` (unique within ``partition_by``).
    Without partition columns the whole table is one ordered sequence; it is cut into
    ranges that are filled side by side.
    """
    c, keep = name(column), df.columns
    if strategy in ("mean", "median", "mode"):
        if strategy == "mode":
            # counted by value first, so that no task holds all of them
            counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            fill = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("__fill"))
        elif is_numeric(df, column):
            fill = with_quantiles(df, c, [0.5]).select(F.col("q")[0].alias("__fill")) if strategy == "median" else df.agg(F.avg(c).alias("__fill"))
        else:
            return df
        return _replace(df.crossJoin(F.broadcast(fill)), column, F.coalesce(c, F.col("__fill")), keep)
    if strategy in ("constant", "custom"):
        return df.withColumn(column, F.coalesce(c, F.lit(value).cast(df.schema[column].dataType)))
    if order_by is None:
        raise ValueError("forward and backward fills need an order key")
    if strategy not in ("ffill", "forward", "bfill", "backward"):
        raise ValueError(f"unknown strategy {strategy!r}")
    forward = strategy in ("ffill", "forward")
    if not partition_by:
        return _replace(_filled_in_ranges(df, column, name(order_by), forward), column, F.coalesce(c, F.col("__inside"), F.col("__carried")), keep)
    # backward from the end on: a frame that ends with the partition would be gone through anew for every row
    w = Window.partitionBy(*partition_by).orderBy(name(order_by) if forward else name(order_by).desc())
    return df.withColumn(column, F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _filled_in_ranges(df: DataFrame, column: str, order: Column, forward: bool, ranges: int = 256) -> DataFrame:
    """Rows with ``__inside``, the nearest known value of the row's range, and ``__carried``, that of the ranges before (or after).

    Ranges of the order key are cut at keys drawn by their hash; only the last (first) known
    value of each of the at most ``ranges`` ranges goes through one window.
    """
    cut = in_ranges(df, order, ranges)
    pick = F.last if forward else F.first
    inner = Window.partitionBy("__part").orderBy("__key" if forward else F.col("__key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(name(column).isNotNull(), F.col("__key"))
    ends = cut.groupBy("__part").agg((F.max_by if forward else F.min_by)(name(column), known).alias("__end"))
    outer = Window.orderBy("__part")  # one row per range
    outer = outer.rowsBetween(Window.unboundedPreceding, -1) if forward else outer.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("__part", pick("__end", ignorenulls=True).over(outer).alias("__carried"))
    return cut.withColumn("__inside", F.last(name(column), ignorenulls=True).over(inner)).join(F.broadcast(carried), "__part")


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns or df.columns)


# --- scaling ----------------------------------------------------------------------


def scale(df: DataFrame, column: str, method: str) -> DataFrame:
    """minmax, standardize (sample deviation), standard (population deviation), robust."""
    c, keep = name(column), df.columns
    if method in ("minmax", "normalize"):
        s = with_stats(df, __a=F.min(c), __b=F.max(c) - F.min(c))
    elif method == "standardize":
        s = with_stats(df, __a=F.avg(c), __b=F.stddev_samp(c))
    elif method == "standard":
        s = with_stats(df, __a=F.avg(c), __b=F.stddev_pop(c))
    elif method == "robust":
        q = F.col("q")
        s = df.crossJoin(F.broadcast(with_quantiles(df, c, [0.25, 0.5, 0.75]).select(q[1].alias("__a"), (q[2] - q[0]).alias("__b"))))
    else:
        raise ValueError(f"unknown method {method!r}")
    flat = F.coalesce(F.col("__b"), F.lit(0)) == 0
    same = c.cast("double") if method in ("minmax", "normalize", "standardize") else (c - F.col("__a")).cast("double")
    return _replace(s, column, F.when(flat, same).otherwise((c - F.col("__a")) / F.col("__b")), keep)


def log_in_place(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(name(column) >= 0, F.log1p(name(column))).otherwise(name(column).cast("double")))


def log_column(df: DataFrame, column: str, variant: str = "log1p", new_name: str | None = None) -> DataFrame:
    c = name(column)
    return df.withColumn(
        new_name or f"{column}_log", F.log1p(c) if variant == "log1p" else F.log(F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(1e-9))))
    )


def sqrt_column(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    c = name(column)
    return df.withColumn(new_name or f"{column}_sqrt", F.sqrt(F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(0.0)))))


# --- bins and codes -----------------------------------------------------------------


def bins(df: DataFrame, column: str, k: int = 5, strategy: str = "cut", new_name: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """Bin numbers 0..k-1: equal width (right-closed) or quantiles (equal edges merged)."""
    c, keep, out = name(column), df.columns, new_name or f"{column}_bin"
    if strategy == "cut":
        s = with_stats(df, __lo=F.min(c).cast("double"), __hi=F.max(c).cast("double"))
        width = (F.col("__hi") - F.col("__lo")) / F.lit(k)
        code = F.when(width == 0, F.lit(k // 2)).otherwise(F.least(
            F.greatest(F.ceil((c - F.col("__lo")) / F.nullif(width, F.lit(0.0))) - 1, F.lit(0)), F.lit(k - 1)
        ))
        code = F.when(c.isNotNull(), code)
    else:
        edges = with_quantiles(df, c, [i / k for i in range(k + 1)]).select(F.array_distinct("q").alias("__edges"))
        s = df.crossJoin(F.broadcast(edges))
        inner = F.slice(F.col("__edges"), 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
        code = F.when(c.isNotNull(), F.size(F.filter(inner, lambda e: e < c)))
    code = code.cast("int")
    if labels:
        code = F.element_at(F.array(*map(F.lit, labels)), code + 1)
    return s.withColumn(out, code).select(*(name(x) for x in keep), name(out))


def one_hot(df: DataFrame, column: str, values: list | None = None) -> DataFrame:
    """0/1 columns ``column_value``; null is all zero; the source column goes."""
    if values is None:
        found = df.select(name(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{column} has more than {MOST_LEVELS} values: name those to encode")
        values = sorted(r["v"] for r in found)
    hot = {f"{column}_{v}": name(column).cast("string").eqNullSafe(F.lit(str(v))).cast("int") for v in values}
    return df.withColumns(hot).drop(column)


def label_encode(df: DataFrame, column: str, null_code: int | None = None) -> DataFrame:
    """Codes by sorted value; null stays null, or gets ``null_code``."""
    codes = df.filter(name(column).isNotNull()).groupBy(name(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    codes = positions(codes, F.col("__v"), "__code").withColumn("__code", F.col("__code").cast("int"))
    out = join_on_value(df, column, codes)
    code = F.col("__code") if null_code is None else F.coalesce(F.col("__code"), F.lit(null_code))
    return _replace(out, column, code, df.columns)


# --- outliers and rows -----------------------------------------------------------------


def clip(df: DataFrame, column: str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    c = name(column).cast("double")
    out = c if lower is None else F.greatest(c, F.lit(float(lower)))
    out = out if upper is None else F.least(out, F.lit(float(upper)))
    return df.withColumn(column, F.when(c.isNotNull(), out))


def _with_fences(df: DataFrame, c: Column, method: str, lower_pct: float = 1, upper_pct: float = 99) -> DataFrame:
    """Every row with the fences __lo and __hi beside it."""
    a, b = F.col("q")[0], F.col("q")[1]
    if method == "iqr":
        q = with_quantiles(df, c, [0.25, 0.75]).select((a - 1.5 * (b - a)).alias("__lo"), (b + 1.5 * (b - a)).alias("__hi"))
    else:
        q = with_quantiles(df, c, [lower_pct / 100, upper_pct / 100]).select(a.alias("__lo"), b.alias("__hi"))
    return df.crossJoin(F.broadcast(q))


def cap_outliers(df: DataFrame, column: str, method: str = "iqr", lower_pct: float = 1, upper_pct: float = 99) -> DataFrame:
    c = name(column).cast("double")
    return _replace(
        _with_fences(df, c, method, lower_pct, upper_pct), column, F.when(c.isNotNull(), F.least(F.greatest(c, F.col("__lo")), F.col("__hi"))),
        df.columns
    )


def drop_outliers(df: DataFrame, column: str, method: str = "iqr", z: float = 3.0) -> DataFrame:
    c = name(column).cast("double")
    keep = [name(x) for x in df.columns]
    if method == "iqr":
        return _with_fences(df, c, "iqr").filter(c.between(F.col("__lo"), F.col("__hi"))).select(*keep)
    middle = with_quantiles(df, c, [0.5]).select(F.col("q")[0].alias("__mid"))
    filled = df.crossJoin(F.broadcast(middle)).withColumn("__x", F.coalesce(c, F.col("__mid")))
    scored = with_stats(filled, __m=F.avg("__x"), __s=F.stddev_pop("__x"))
    return scored.filter(F.abs((F.col("__x") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))) < z).select(*keep)


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The first row of each group along ``order_by``; without a subset, distinct rows."""
    if not subset:
        return df.distinct()
    if not order_by:
        raise ValueError("a subset needs an order key to say which row is first")
    w = Window.partitionBy(*(name(c) for c in subset)).orderBy(*(name(c) for c in order_by))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def sample_rows(df: DataFrame, keys: list[str], n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """A repeatable sample drawn by a hash of the key columns."""
    h = F.xxhash64(*(name(k) for k in keys), F.lit(seed))
    if n is not None:
        return df.orderBy(h, *(name(k) for k in keys)).limit(n)
    return df.filter(F.pmod(h, F.lit(1 << 30)) < F.lit(int((fraction or 0) * (1 << 30))))


def sort_rows(df: DataFrame, by: list[str], ascending: list[bool] | bool = True) -> DataFrame:
    flags = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    return df.orderBy(*(name(c).asc_nulls_last() if up else name(c).desc_nulls_last() for c, up in zip(by, flags)))


PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "weekday": F.weekday, "quarter": F.quarter}


def datetime_parts(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Columns ``column_part``; Monday is weekday 0."""
    return df.withColumns({f"{column}_{p}": PARTS[p](name(column)) for p in parts})


def clean_text(
    df: DataFrame, column: str, strip: bool = False, lower: bool = False, upper: bool = False, find: str | None = None, replace: str = "",
    regex: bool = False, alphanumeric: bool = False
) -> DataFrame:
    """Text operations in a fixed order: strip, lower, upper, replace, strip symbols."""
    c = name(column)
    if strip:
        c = F.regexp_replace(c, r"^\s+|\s+$", "")
    if lower:
        c = F.lower(c)
    if upper:
        c = F.upper(c)
    if find is not None:
        c = F.regexp_replace(c, find, replace) if regex else F.replace(c, F.lit(find), F.lit(replace))
    if alphanumeric:
        c = F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")
    return df.withColumn(column, c)


# --- pipeline -------------------------------------------------------------------------

Step = Callable[..., DataFrame]

#: The step vocabulary: type -> (function, names of its parameters).
STEPS: dict[str, tuple[Step, tuple[str, ...]]] = {
    "drop_columns": (drop_columns, ("columns",)),
    "rename_column": (rename_column, ("column", "new_name")),
    "select_columns": (select_columns, ("columns",)),
    "reorder_columns": (reorder_columns, ("order",)),
    "create_column": (create_column, ("new_name", "expression")),
    "cast_type": (cast_column, ("column", "to_type")),
    "cast_if_all": (cast_if_all, ("column", "dtype")),
    "drop_high_missing": (drop_high_missing, ("threshold",)),
    "fill_missing": (fill, ("column", "strategy", "value", "order_by", "partition_by")),
    "drop_rows_where_null": (drop_null_rows, ("columns",)),
    "scale": (scale, ("column", "method")),
    "log_in_place": (log_in_place, ("column",)),
    "log_transform": (log_column, ("column", "variant", "new_name")),
    "sqrt_transform": (sqrt_column, ("column", "new_name")),
    "bin": (bins, ("column", "k", "strategy", "new_name", "labels")),
    "one_hot_encode": (one_hot, ("column", "values")),
    "label_encode": (label_encode, ("column", "null_code")),
    "clip": (clip, ("column", "lower", "upper")),
    "cap_outliers": (cap_outliers, ("column", "method", "lower_pct", "upper_pct")),
    "drop_outliers": (drop_outliers, ("column", "method", "z")),
    "drop_duplicates": (drop_duplicates, ("subset", "order_by")),
    "sample_rows": (sample_rows, ("keys", "n", "fraction", "seed")),
    "sort_rows": (sort_rows, ("by", "ascending")),
    "extract_datetime": (datetime_parts, ("column", "parts")),
    "text_clean": (clean_text, ("column", "strip", "lower", "upper", "find", "replace", "regex", "alphanumeric")),
    "filter_rows": (lambda df, column, operator, value=None: df.filter(typed_condition(df, column, operator, value)), ("column", "operator", "value")),
}


def check_steps(steps: list[dict]) -> list[str]:
    """What is wrong with a step list, before anything is planned."""
    wrong = []
    for i, s in enumerate(steps):
        if s.get("type") not in STEPS:
            wrong.append(f"step {i}: unknown type {s.get('type')!r}")
        elif extra := set(s) - {"type"} - set(STEPS[s["type"]][1]):
            wrong.append(f"step {i}: unknown parameters {sorted(extra)}")
    return wrong


def run_pipeline(df: DataFrame, steps: list[dict]) -> tuple[DataFrame, list[str]]:
    """Fold the steps in order; a step that fails is logged and left out."""
    log = []
    for i, s in enumerate(steps):
        try:
            if wrong := check_steps([s]):
                raise ValueError(wrong[0].partition(": ")[2])
            done = STEPS[s["type"]][0](df, **{k: v for k, v in s.items() if k != "type"})
            done.schema  # noqa: B018  analysis errors belong to this step
            df = done
        except Exception as e:
            log.append(f"step {i} ({s.get('type')}): {str(e).splitlines()[0]}")
    return df, log


def preview(df: DataFrame, steps: list[dict], rows: int = 50) -> tuple[DataFrame, list[str]]:
    out, log = run_pipeline(df, steps)
    return out.limit(rows), log


