"""Profiles, missing values and quality scores. Exact, over all rows, a column per result row.

Statistics of all columns come from one wide aggregate; distinct values and
top values from one grouped pass over (column, value), so the number of jobs
does not grow with the number of columns. ``approx=True`` replaces exact distinct
counts and medians by sketches for very wide or very large tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tidewell.functions.cleaning import NUMERIC, TEMPORAL, correlation, is_numeric, name, numeric_columns, share
from tidewell.operators.ranks import column_quantiles, exact_quantiles

STATS = ("min", "max", "mean", "median", "std", "skewness", "kurtosis")


def unbiased_skewness(c: Column) -> Column:
    """Sample skewness from the population moment."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def unbiased_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis from the population moment."""
    n = F.count(c).cast("double")
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


def one_row_per_column(df: DataFrame, columns: list[str], fields: dict[str, object]) -> DataFrame:
    """Aggregate each of ``fields`` (name -> function of a column name) once, then unpivot."""
    aggs = [f(c).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, f in fields.items()]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{i}_{k}").alias(k) for k in fields)) for i, c in enumerate(columns)))
    return df.agg(*aggs).select(F.inline(rows))


def values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (column_name, value, n) of all non-null values, as text."""
    columns = columns or df.columns
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), name(c).cast("string").alias("value")) for c in columns))).alias("x"))
    return long.select("x.*").filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    columns = columns or df.columns
    if approx:
        return one_row_per_column(df, columns, {"distinct_n": lambda c: F.approx_count_distinct(name(c))})
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    counted = None
    for same in kinds.values():  # one pass per type, on the values themselves
        plain = not isinstance(df.schema[same[0]].dataType, (MapType, VariantType))  # these can't be grouped
        v = lambda c, plain=plain: name(c) if plain else name(c).cast("string")
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), v(c).alias("v")) for i, c in enumerate(same))))
        one = df.select(cells.alias("x")).select("x.*").filter("v IS NOT NULL").groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("one").alias("distinct_n"))
        one = one.select(F.element_at(F.array(*map(F.lit, same)), F.col("i") + 1).alias("column_name"), "distinct_n")
        counted = one if counted is None else counted.unionByName(one)
    every = one_row_per_column(df, columns, {"_n": lambda c: F.count(F.lit(1))}).drop("_n")
    return every.join(F.broadcast(counted), "column_name", "left").withColumn("distinct_n", F.coalesce("distinct_n", F.lit(0)).cast("long"))


def _kind(df: DataFrame, c: str) -> str:
    kind = df.schema[c].dataType
    if kind.simpleString() == "boolean":
        return "boolean"
    return "numeric" if isinstance(kind, NUMERIC) else "datetime" if isinstance(kind, TEMPORAL) else "text"


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, semantic type, missing, distinct, and numeric statistics."""

    def numeric(f):
        return lambda c: f(name(c).cast("double")) if is_numeric(df, c) else F.lit(None).cast("double")

    made = {
        "min": F.min, "max": F.max, "mean": F.avg, "approx": lambda c: F.percentile_approx(c, 0.5), "std": F.stddev_samp,
        "skewness": unbiased_skewness, "kurtosis": unbiased_kurtosis
    }
    fields = {
        "dtype": lambda c: F.max(F.lit(df.schema[c].dataType.simpleString())),
        "kind": lambda c: F.max(F.lit(_kind(df, c))),
        "total": lambda c: F.count(F.lit(1)),
        "missing": lambda c: F.count_if(name(c).isNull()),
        "length": lambda c: F.avg(F.length(name(c).cast("string"))) if _kind(df, c) == "text" else F.lit(None).cast("double"),
        **{k: numeric(f) for k, f in made.items()},
    }
    if not approx:
        fields.pop("approx")
    out = one_row_per_column(df, df.columns, fields).join(F.broadcast(distinct_counts(df, approx=approx)), "column_name")
    numbers = [c for c in df.columns if is_numeric(df, c)]
    if approx or not numbers:
        out = out.withColumn("median", F.col("approx") if approx else F.lit(None).cast("double"))
    else:
        out = out.join(F.broadcast(column_quantiles(df, numbers, [0.5])), "column_name", "left").withColumn("median", F.col("q")[0])
    distinct_share = F.try_divide(F.col("distinct_n"), F.col("total"))
    semantic = (
        F.when(F.col("kind").isin("boolean", "datetime"), F.col("kind")).when(F.col("distinct_n") <= 1, "constant")
        .when((distinct_share > 0.95) & (F.col("distinct_n") > 100), "id_like").when(F.col("kind") == "numeric", "numeric")
        .when(F.col("length") > 50, "text").otherwise("categorical")
    )
    return out.select(
        "column_name", "dtype", semantic.alias("semantic_type"), "total", "missing", share(F.col("missing"), F.col("total")).alias("missing_pct"),
        "distinct_n", (distinct_share * 100).alias("distinct_pct"), *STATS
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """Rows (column_name, rank, value, n, pct); ties by value."""
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = values(df, columns).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.crossJoin(F.broadcast(total)).select(
        "column_name", F.col("rank").cast("long").alias("rank"), "value", "n", share(F.col("n"), F.col("total")).alias("pct")
    )


def duplicates(df: DataFrame) -> DataFrame:
    """One row (total, duplicate_rows, duplicate_pct): extra copies of equal rows, nulls equal."""
    copies = df.groupBy(*(name(c) for c in df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    out = copies.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    return out.select("total", "duplicate_rows", share(F.col("duplicate_rows"), F.col("total")).alias("duplicate_pct"))


WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def memory_estimate(df: DataFrame) -> DataFrame:
    """One row (memory_mb): fixed widths plus the bytes of texts; an approximation."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        size = size + (F.coalesce(F.octet_length(name(f.name)), F.lit(0)) if kind == "string" else F.lit(WIDTHS.get(kind, 8)))
    return df.agg((F.sum(size.cast("long")) / F.lit(1 << 20)).alias("memory_mb"))


# --- missing values -------------------------------------------------------------------


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with nulls: missing and missing_pct, most first."""
    out = one_row_per_column(df, df.columns, {"total": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(name(c).isNull())})
    return out.filter("missing > 0").select(
        "column_name", "missing", share(F.col("missing"), F.col("total")).alias("missing_pct")
    ).orderBy(F.col("missing").desc(), "column_name")


def missing_total(df: DataFrame) -> DataFrame:
    """One row (cells, missing, missing_pct) over all cells."""
    nulls = sum((name(c).isNull().cast("long") for c in df.columns), F.lit(0))
    out = df.agg((F.count(F.lit(1)) * len(df.columns)).alias("cells"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing"))
    return out.select("cells", "missing", share(F.col("missing"), F.col("cells")).alias("missing_pct"))


def _pairs(df: DataFrame, pairs: list[tuple[str, str, Column]], labels: tuple[str, str], value: str) -> DataFrame:
    """All pair statistics in one aggregate, unpivoted."""
    if not pairs:
        return df.sparkSession.createDataFrame([], f"{labels[0]} string, {labels[1]} string, {value} double")
    rows = F.array(*(F.struct(F.lit(a).alias(labels[0]), F.lit(b).alias(labels[1]), F.col(f"p{i}").alias(value)) for i, (a, b, _) in enumerate(pairs)))
    return df.agg(*(c.alias(f"p{i}") for i, (_, _, c) in enumerate(pairs))).select(F.inline(rows))


def _null_flag(c: str) -> Column:
    return name(c).isNull().cast("double")


def missing_together(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation of the null indicators of column pairs; null where an indicator is constant."""
    columns = columns or df.columns
    pairs = [(a, b, correlation(_null_flag(a), _null_flag(b))) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return _pairs(df, pairs, ("column_a", "column_b"), "r").filter("r IS NOT NULL")


def missing_mechanism(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per column with nulls: MAR with the numeric columns its gaps go with, else MCAR."""
    numeric = numeric_columns(df)
    pairs = [(a, b, correlation(_null_flag(a), name(b).cast("double"))) for a in df.columns for b in numeric if a != b]
    linked = _pairs(df, pairs, ("column_name", "other"), "r").filter(F.abs("r") > threshold)
    linked = linked.groupBy("column_name").agg(F.array_sort(F.collect_list("other")).alias("related"))
    out = missing_table(df).join(F.broadcast(linked), "column_name", "left")
    return out.select(
        "column_name", F.when(F.col("related").isNull(), "MCAR").otherwise("MAR").alias("mechanism"),
        F.coalesce(F.array_join("related", ","), F.lit("")).alias("related")
    )


def imputation(df: DataFrame) -> DataFrame:
    """Per column with nulls: median for skewed numbers, mean for others, mode for the rest."""
    found = column_profile(df).filter("missing > 0")
    return found.select("column_name", F.when(F.col("mean").isNull(), "mode").when(F.abs("skewness") > 1, "median").otherwise("mean").alias("suggestion"))


# --- quality --------------------------------------------------------------------------


def quality_score(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row: completeness, consistency, uniqueness, overall (0 to 100)."""
    p = (profile or column_profile(df)).agg(
        (F.lit(100) - F.try_divide(100.0 * F.sum("missing"), F.sum("total"))).alias("c"),
        (F.lit(100) - 100.0 * F.count_if(F.col("semantic_type") == "constant") / F.count(F.lit(1))).alias("k")
    )
    both = p.crossJoin(F.broadcast(duplicates(df)))
    parts = both.select(
        F.coalesce("c", F.lit(100.0)).cast("int").alias("completeness"), F.col("k").cast("int").alias("consistency"),
        (F.lit(100) - F.coalesce("duplicate_pct", F.lit(0.0))).cast("int").alias("uniqueness")
    )
    return parts.withColumn("overall", (0.5 * F.col("completeness") + 0.25 * F.col("consistency") + 0.25 * F.col("uniqueness")).cast("int"))


def quality_issues(df: DataFrame, profile: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Rows (column_name, issue, severity), worst first, at most ``limit``."""
    p = profile or column_profile(df)
    rules = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 50, F.struct(F.lit("missing_critical").alias("issue"), F.lit(0).alias("severity"))),
        F.when((F.col("missing_pct") > 20) & (F.col("missing_pct") <= 50), F.struct(F.lit("missing_moderate").alias("issue"), F.lit(1).alias("severity"))),
        F.when(F.col("semantic_type") == "constant", F.struct(F.lit("constant").alias("issue"), F.lit(1).alias("severity"))),
        F.when(F.abs("skewness") > 2, F.struct(F.lit("high_skew").alias("issue"), F.lit(2).alias("severity"))),
        F.when(
            (F.col("semantic_type") == "categorical") & (F.col("distinct_pct") > 50),
            F.struct(F.lit("high_cardinality").alias("issue"), F.lit(2).alias("severity"))
        ),
    ))
    found = p.select("column_name", F.explode(rules).alias("x")).select("column_name", "x.*")
    rows = duplicates(df).filter("duplicate_pct > 5").select(F.lit("*").alias("column_name"), F.lit("duplicates").alias("issue"), F.lit(1).alias("severity"))
    return found.unionByName(rows).orderBy("severity", "column_name", "issue").limit(limit)


SUGGESTIONS = {
    "missing_critical": "drop the column or find its source", "missing_moderate": "fill the missing values", "constant": "drop the constant column",
    "high_skew": "transform the skewed column", "high_cardinality": "group rare values", "duplicates": "remove duplicate rows",
}


def suggestions(issues: DataFrame, limit: int = 10) -> DataFrame:
    text = F.create_map(*(F.lit(x) for kv in SUGGESTIONS.items() for x in kv))
    return issues.select(text[F.col("issue")].alias("suggestion")).distinct().orderBy("suggestion").limit(limit)


def column_detail(df: DataFrame, column: str) -> DataFrame:
    """One row of a numeric column's statistics; moments are population moments here."""
    c = name(column).cast("double")
    s = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))
    s = s.crossJoin(F.broadcast(exact_quantiles(df, [], c, [0.25, 0.75])))
    s = s.select("n", "mean", "std", "skewness", "kurtosis", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    outside = df.select(c.alias("x")).crossJoin(F.broadcast(s)).agg(F.count_if((F.col("x") < F.col("q1") - fence) | (F.col("x") > F.col("q3") + fence)).alias("outliers"))
    return s.crossJoin(F.broadcast(outside))


def cardinality(df: DataFrame) -> DataFrame:
    """Per column: distinct values and a class by their number."""
    out = distinct_counts(df).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    n = F.col("distinct_n")
    kind = F.when(n > 0.95 * F.col("total"), "id_like").when(n <= 1, "constant").when(n == 2, "binary").when(n < 10, "low_cardinality").otherwise("normal")
    return out.select("column_name", "distinct_n", kind.alias("class")).orderBy(n.desc(), "column_name")


def analysis_batch(df: DataFrame, steps: dict[str, object]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Independent analyses of one dataset; one that fails doesn't stop the rest."""
    done, failed = {}, {}
    for k, f in steps.items():
        try:
            done[k] = f(df)
            done[k].schema  # noqa: B018
        except Exception as e:
            failed[k] = str(e).splitlines()[0]
    return done, failed
