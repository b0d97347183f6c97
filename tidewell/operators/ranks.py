"""Ranks and running sums over large columns without one task for all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import name


def running_before(counts: DataFrame, value: str, sums: list[str], buckets: int = 64) -> DataFrame:
    """Add ``before_x`` for each of ``sums``: its total over all smaller values.

    ``counts`` has one row per value. Approximate quantiles cut the values into
    buckets; sums run inside a bucket and start at the total of the buckets before.
    """
    v = name(value)
    edges = counts.agg(F.coalesce(F.percentile_approx(v, [i / buckets for i in range(1, buckets)], 1000), F.array().cast("array<double>")).alias("__edges"))
    cut = counts.crossJoin(F.broadcast(edges)).withColumn("__bucket", F.size(F.filter("__edges", lambda e: e < v))).drop("__edges")
    whole = cut.groupBy("__bucket").agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    w = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    start = whole.select("__bucket", *(F.coalesce(F.sum(f"__{s}").over(w), F.lit(0)).alias(f"__start_{s}") for s in sums))
    inner = Window.partitionBy("__bucket").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(start), "__bucket")
    return out.select(
        *(name(c) for c in counts.columns), *((F.col(f"__start_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0))).alias(f"before_{s}") for s in sums)
    )


def join_on_value(df: DataFrame, column: str, right: DataFrame, share: int = 20_000, least: int = 1000) -> DataFrame:
    """Left join with ``right``: one row per value (__v, how often the column has it as __n, ...), dropping both.

    A value with more than ``1 / share`` of the rows (so at most ``share`` values) comes in as
    many copies as it has such shares, and the rows of ``df`` go to one of them by a hash; nulls,
    which match nothing, are spread likewise. So no value's rows meet in one task.
    """
    total = right.agg(F.sum("__n").alias("__t"))
    parts = F.ceil(F.col("__n") / F.greatest(F.lit(float(least)), F.col("__t") / share)).cast("int")
    r = right.crossJoin(F.broadcast(total)).withColumn("__parts", parts)
    frequent = r.filter("__parts > 1").select(F.col("__v").alias("__f"), F.col("__parts").alias("__of"))
    # rows that are equal in all columns are told apart by the partition they stand in
    h = F.xxhash64(*(name(c) for c in df.columns), F.spark_partition_id())
    salt = F.when(name(column).isNull(), F.pmod(h, F.lit(share))).when(F.col("__of").isNotNull(), F.pmod(h, F.col("__of").cast("long"))).otherwise(F.lit(0).cast("long"))
    rows = df.join(F.broadcast(frequent), name(column) == F.col("__f"), "left").withColumn("__salt", salt).drop("__f", "__of")
    copies = r.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__parts"), F.lit(1)).cast("long") - 1)))
    fits = (name(column) == F.col("__v")) & (F.col("__salt") == F.col("__copy"))
    return rows.join(copies.drop("__parts", "__t", "__n"), fits, "left").drop("__v", "__salt", "__copy")


#: Ranges a column is cut into for ranks, and rows of a task that ranks them.
RANK_RANGES, TASK_ROWS = 1024, 250_000


def repeated(quantiles: Column) -> Column:
    """The values that an ascending array holds more than once."""
    n = F.greatest(F.size(quantiles) - 1, F.lit(0))
    return F.array_distinct(F.array_compact(F.zip_with(F.slice(quantiles, 1, n), F.slice(quantiles, 2, n), lambda x, y: F.when(x == y, x))))


def with_rank(df: DataFrame, column: str, out: str, ranges: int = RANK_RANGES) -> DataFrame:
    """Add the average rank of a column's values; null stays null.

    The column is cut at quantiles; ranks run inside a range, where the rows stand, and
    start at the number of rows below it. A value that several quantiles are has a range of
    its own, whose rows share one known rank and are spread over tasks, like nulls.
    """
    v = name(column).cast("double")
    q, total = df.agg(F.percentile_approx(v, [i / ranges for i in range(1, ranges)], 10_000), F.count(F.lit(1))).first()  # ``ranges`` numbers at most
    edges, times = np.unique(np.array(q or [], float), return_counts=True)
    single = edges[times > 1]

    @F.pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        # even numbers are ranges, an odd one a single value at its range's upper end
        return pd.Series((2 * np.searchsorted(edges, x.to_numpy(float), "left") + np.isin(x, single)).astype("int32"))

    cut = df.withColumn("__v", v).withColumn("__part", part("__v")).withColumn("__one", F.col("__part") % 2 == 1)
    sizes = cut.filter("__v IS NOT NULL").groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))  # at most twice the ranges
    apart = F.col("__v").isNull() | F.col("__one")
    spread = F.when(apart, F.pmod(F.xxhash64(*(name(c) for c in df.columns), F.spark_partition_id()), F.lit(4096))).otherwise(F.lit(0).cast("long"))
    placed = cut.join(F.broadcast(start), "__part", "left").withColumn("__salt", spread)
    # so many tasks that one sorts ``TASK_ROWS`` or so: sizes of compressed shuffle files say little about rows in memory
    placed = placed.repartition(max(1, -(-total // TASK_ROWS)), "__part", "__salt")
    w = Window.partitionBy("__part", "__salt")
    inside = F.rank().over(w.orderBy("__v")) + (F.count(F.lit(1)).over(Window.partitionBy("__part", "__salt", "__v")) - 1) / 2
    rank = F.when(F.col("__v").isNotNull(), F.col("__before") + F.when(F.col("__one"), (F.col("__n") + 1) / 2).otherwise(inside))
    return placed.withColumn(out, rank).select(*(name(c) for c in df.columns if c != out), out)


def in_ranges(rows: DataFrame, key: Column, ranges: int = 256) -> DataFrame:
    """Add ``__key`` and ``__part``, the range (from 0) that the key falls in; ranges are cut at keys drawn by their hash."""
    keyed = rows.withColumn("__key", key)
    k = F.col("__key")
    cuts = keyed.select(k).orderBy(F.xxhash64(k), k).limit(ranges - 1).agg(F.sort_array(F.collect_list(k)).alias("__cuts"))
    return keyed.crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("__cuts", lambda e: e < k))).drop("__cuts")


def positions(rows: DataFrame, key: Column, out: str, buckets: int = 256) -> DataFrame:
    """Add ``out``, the place (from 0) of each row in the order of ``key``, without one task for all.

    Keys drawn by their hash cut the rest into buckets; places run inside a bucket
    and start at the sizes of the buckets before (``buckets`` rows in one window). Keys
    should be unique: equal ones take neighbouring places in any order.
    """
    cut = in_ranges(rows, key, buckets)
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy("__key")) - 1
    return cut.join(F.broadcast(start), "__part").withColumn(out, F.col("__start") + inner).drop("__part", "__start", "__key")


#: Rank error of the sketch below, and how far around a quantile values are counted one by one.
SKETCH_ACCURACY, MARGIN = 10_000, 3e-4


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column, points: list[float], out: str = "q", few: bool = False) -> DataFrame:
    """Rows (keys, out): exact interpolated quantiles of each group, nulls left out.

    A sketch brackets each quantile; values below its bracket only add to a count, and
    the values inside it (a share of ``2 * MARGIN`` of the rows) are counted one by one
    and put in order. No task holds all distinct values of a group. Groups of up to
    ``SKETCH_ACCURACY`` rows are bracketed whole. Without keys there is always one row.
    """
    x = rows.select(*(name(k).alias(f"__k{i}") for i, k in enumerate(keys)), value.cast("double").alias("__v")).filter("__v IS NOT NULL")
    ks = [f"__k{i}" for i in range(len(keys))]
    ends = [e for p in points for e in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    sketch = x.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", ends, SKETCH_ACCURACY).alias("__e"))
    if keys:
        own = sketch.select(*(F.col(k).alias(f"{k}_s") for k in ks), "__n", "__e")
        same = F.lit(True)
        for k in ks:
            same &= F.col(k).eqNullSafe(F.col(f"{k}_s"))
        both = x.join(F.broadcast(own) if few else own, same)
    else:
        both = x.crossJoin(F.broadcast(sketch))
    cells = []
    for i, p in enumerate(points):
        narrow = F.col("__n") > SKETCH_ACCURACY
        below = narrow & (F.col("__v") < F.col("__e")[2 * i]) if p > MARGIN else F.lit(False)
        above = narrow & (F.col("__v") > F.col("__e")[2 * i + 1]) if p < 1 - MARGIN else F.lit(False)
        cells.append(F.when(~above, F.struct(F.lit(i).alias("__i"), F.when(~below, F.col("__v")).alias("__x"))))
    counted = both.select(*ks, "__n", F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy(*ks, "__n", "c").agg(F.count(F.lit(1)).alias("__c"))
    counted = counted.select(*ks, "__n", "c.*", "__c")
    w = Window.partitionBy(*ks, "__i").orderBy(F.col("__x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    at = F.array(*(F.lit(float(p)) for p in points))[F.col("__i")] * (F.col("__n") - 1)
    placed = counted.withColumns({"__b": F.coalesce(F.sum("__c").over(w), F.lit(0)), "__at": at})
    holds = lambda place: (F.col("__b") <= place) & (place < F.col("__b") + F.col("__c"))
    ends_of = placed.groupBy(*ks, "__i").agg(
        F.max(F.when(holds(F.floor("__at")), F.col("__x"))).alias("lo"), F.max(F.when(holds(F.ceil("__at")), F.col("__x"))).alias("hi"), F.max(F.col("__at") - F.floor("__at")).alias("part"),
    )
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    found = ends_of.withColumn("q", q).groupBy(*ks).agg(*(F.max(F.when(F.col("__i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(points))))
    return found.select(*(F.col(k).alias(c) for k, c in zip(ks, keys)), F.array(*(f"q{i}" for i in range(len(points)))).alias(out))


def column_quantiles(df: DataFrame, columns: list[str], points: list[float], out: str = "q") -> DataFrame:
    """Rows (column_name, out): exact quantiles of each numeric column; columns without a value are left out."""
    items = F.array(*(F.struct(F.lit(c).alias("column_name"), name(c).cast("double").alias("v")) for c in columns))
    return exact_quantiles(df.select(F.explode(items).alias("i")).select("i.*"), ["column_name"], F.col("v"), points, out, few=True)
