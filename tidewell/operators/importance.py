"""Feature importance for a target: problem type, associations, mutual information, models.

Forests whose rows out of the bag, refits and Shapley values are needed are in ``forests``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import correlation, is_numeric, name, share
from tidewell.operators.assoc import categorical_matrix, mixed_matrix, numeric_pairs
from tidewell.operators.profile import _pairs, column_profile
from tidewell.operators.ranks import column_quantiles


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """One row (problem_type, classes, rows): few distinct numbers, or no numbers at all, mean classification."""
    c = name(target)
    s = df.filter(c.isNotNull()).agg(F.count_distinct(c).alias("classes"), F.count(F.lit(1)).alias("rows"))
    if not is_numeric(df, target):
        return s.select(F.lit("classification").alias("problem_type"), "classes", "rows")
    few = (F.col("classes") <= 20) & (F.col("classes") < 0.05 * F.col("rows"))
    return s.select(F.when(few, "classification").otherwise("regression").alias("problem_type"), "classes", "rows")


def class_distribution(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Rows (value, n, pct), most first."""
    c = df.filter(name(target).isNotNull()).groupBy(name(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("value", "n", share(F.col("n"), F.col("total")).alias("pct")).orderBy(F.col("n").desc(), "value").limit(k)


def feature_metadata(df: DataFrame, target: str) -> DataFrame:
    """Rows (feature, dtype, missing_pct, distinct_n)."""
    p = column_profile(df.filter(name(target).isNotNull()).drop(target))
    return p.select(F.col("column_name").alias("feature"), "dtype", "missing_pct", "distinct_n")


def feature_matrix(df: DataFrame, target: str, features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows without null target; texts become alphabetical codes, nulls the median with an indicator.

    Adds ``features`` (vector) and ``label``; returns the feature names in order.
    """
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler

    features = features or [c for c in df.columns if c != target]
    rows, names = df.filter(name(target).isNotNull()), []
    for c in features:
        if is_numeric(df, c):
            rows = rows.withColumn(f"f_{c}", name(c).cast("double"))
        else:
            rows = rows.withColumn(f"__t_{c}", name(c).cast("string"))
            made = StringIndexer(inputCol=f"__t_{c}", outputCol=f"f_{c}", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
            rows = made.transform(rows).drop(f"__t_{c}").withColumn(f"f_{c}", F.when(name(c).isNotNull(), F.col(f"f_{c}")))
        names.append(c)
    holes = rows.agg(*(F.count_if(F.col(f"f_{c}").isNull()).alias(f"n{i}") for i, c in enumerate(names))).first()
    gaps = [c for i, c in enumerate(names) if holes[i]]
    columns = [f"f_{c}" for c in names]
    if gaps:
        rows = rows.withColumns({f"f_{c}__missing": F.col(f"f_{c}").isNull().cast("double") for c in gaps})
        rows = Imputer(inputCols=[f"f_{c}" for c in gaps], outputCols=[f"f_{c}" for c in gaps], strategy="median").fit(rows).transform(rows)
        columns += [f"f_{c}__missing" for c in gaps]
        names = [*names, *(f"{c}__missing" for c in gaps)]
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    if is_numeric(df, target):
        return rows.withColumn("label", name(target).cast("double")), names
    made = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    return made.transform(rows), names


def associations(df: DataFrame, target: str, features: list[str] | None = None, least: int = 5) -> DataFrame:
    """Rows (feature, method, strength, f_score): Pearson, eta or Cramér's V by the columns' kinds."""
    rows = df.filter(name(target).isNotNull())
    features = features or [c for c in df.columns if c != target]
    numbers, texts = [c for c in features if is_numeric(df, c)], [c for c in features if not is_numeric(df, c)]
    n = F.count_if
    if is_numeric(df, target):
        r = _pairs(
            rows, [(target, c, F.when(n(name(c).isNotNull()) >= least, correlation(name(c), name(target)))) for c in numbers], ("t", "feature"), "r"
        ) if numbers else None
        counts = _pairs(rows, [(target, c, n(name(c).isNotNull()).cast("double")) for c in numbers], ("t", "feature"), "n") if numbers else None
        out = r.join(F.broadcast(counts), ["t", "feature"]).select(
            "feature", F.lit("pearson").alias("method"), F.abs("r").alias("strength"),
            F.try_divide(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")).alias("f_score")
        ) if numbers else None
        if texts:
            m = mixed_matrix(rows, [target], texts).select(
                F.col("category").alias("feature"), F.lit("eta").alias("method"), F.sqrt(F.greatest("eta2", F.lit(0.0))).alias("strength"),
                F.col("f").alias("f_score")
            )
            out = m if out is None else out.unionByName(m)
        return out
    out = None
    if numbers:
        out = mixed_matrix(rows, numbers, [target]).select(
            F.col("numeric").alias("feature"), F.lit("eta").alias("method"), F.sqrt(F.greatest("eta2", F.lit(0.0))).alias("strength"),
            F.col("f").alias("f_score")
        )
    if texts:
        v = categorical_matrix(rows, [target, *texts], least).filter(F.col("column_a") == target)
        v = v.select(
            F.col("column_b").alias("feature"), F.lit("cramers_v").alias("method"), F.col("cramers_v").alias("strength"),
            F.lit(None).cast("double").alias("f_score")
        )
        out = v if out is None else out.unionByName(v)
    return out


def digamma(n: Column) -> Column:
    """For whole numbers from 1 on: harmonic numbers below 12, the asymptotic series from there."""
    below = F.array(*(F.lit(-0.5772156649015329 + sum(1 / i for i in range(1, k))) for k in range(1, 12)))
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return F.when(n < 12, F.element_at(below, n.cast("int"))).otherwise(series)


def _plug_in(cells: DataFrame) -> DataFrame:
    """Rows (feature, mi) from counts ``o`` by (feature, x, y): sums of o ln o over cells, rows and columns."""
    ln = lambda c: F.sum(F.col(c) * F.log(F.col(c)))
    joint = cells.groupBy("feature").agg(ln("o").alias("joint"), F.sum("o").alias("n"))
    sides = [cells.groupBy("feature", c).agg(F.sum("o").alias("o")).groupBy("feature").agg(ln("o").alias(f"s{c}")) for c in "xy"]
    mi = (F.col("joint") - F.col("sx") - F.col("sy")) / F.col("n") + F.log("n")
    return joint.join(sides[0], "feature").join(sides[1], "feature").select("feature", mi.alias("mi"))


def binned_information(df: DataFrame, target: str, features: list[str], bins: int = 10) -> DataFrame:
    """Rows (feature, mi) in nats: numbers cut into quantile bins, all features in one group."""
    def code(c: str) -> Column:
        if not is_numeric(df, c):
            return name(c).cast("string")
        return F.size(F.filter(F.col(f"__e_{c}"), lambda e: e < name(c))).cast("string")

    numbers = [c for c in [target, *features] if is_numeric(df, c)]
    rows = df.filter(name(target).isNotNull())
    if numbers:
        q = column_quantiles(rows, numbers, [i / bins for i in range(1, bins)])
        edges = q.agg(*(F.array_distinct(F.max(F.when(F.col("column_name") == c, F.col("q")))).alias(f"__e_{c}") for c in numbers))
        rows = rows.crossJoin(F.broadcast(edges))
    items = F.array(*(F.struct(F.lit(c).alias("feature"), F.when(name(c).isNotNull(), code(c)).alias("x"), code(target).alias("y")) for c in features))
    cells = rows.select(F.explode(items).alias("i")).select("i.*").filter("x IS NOT NULL").groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("o"))
    return _plug_in(cells)


#: Buckets in which values are put in order.
ORDER_BUCKETS = 128


def nearest_information(items: DataFrame, neighbours: int = 3, size: int = 100_000) -> DataFrame:
    """Rows (feature, mi) in nats between a number ``x`` and a class ``y`` per feature, by nearest neighbours.

    A value's radius is the distance to its k-th neighbour of the same class; what counts
    is how many rows of all classes are nearer. (Where k others of the class have the very
    value, all rows of that value count, as for the mixed case of discrete and continuous.)
    Neighbours come from blocks of a class's values in order, with a halo; the rows that are
    nearer from running counts over values and radii's ends in one order, bucket by bucket.
    """
    cells = items.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("feature", "y").agg(F.sum("n").alias("size"))
    cells = cells.join(sizes.filter("size > 1"), ["feature", "y"])  # a class of one row has no neighbour
    points = [i / ORDER_BUCKETS for i in range(1, ORDER_BUCKETS)]
    edges = cells.groupBy("feature").agg(F.array_distinct(F.percentile_approx("x", points, 10_000)).alias("edges"))  # one row per feature
    bucketed = lambda df, v: df.join(F.broadcast(edges), "feature").withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col(v)))).drop("edges")
    cut = bucketed(cells, "x")
    by = ["feature", "y"]
    inner = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("x")) - 1
    ahead = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per bucket
    start = cut.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c")).select(*by, "bucket", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start"))
    placed = cut.join(start, [*by, "bucket"]).select(*by, "x", "n", "size", (F.col("start") + inner).alias("i"))
    k = neighbours
    blocks = F.sequence(F.floor(F.greatest(F.col("i") - k, F.lit(0)) / size), F.floor((F.col("i") + k) / size))
    halo = placed.withColumn("block", F.explode(blocks))

    def radii(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy()
        want = np.minimum(k, pdf["size"].to_numpy() - 1)
        far, count = [np.zeros(len(x))], [n - 1]
        for step in range(1, k + 1):
            for side in (1, -1):
                d, c = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
                a, b = (slice(step, None), slice(None, -step)) if side == 1 else (slice(None, -step), slice(step, None))
                d[b], c[b] = np.abs(x[a] - x[b]), n[a]
                far.append(d)
                count.append(c)
        far, count = np.stack(far, 1), np.stack(count, 1)
        order = np.argsort(far, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(count, order, 1), axis=1) >= want[:, None]
        r = np.take_along_axis(far, order, 1)[np.arange(len(x)), reached.argmax(1)]
        own = (pdf["i"] // size).to_numpy() == key[2]
        found = pd.DataFrame({"feature": key[0], "y": key[1], "x": x, "n": n, "size": pdf["size"], "r": r, "k": np.where(r > 0, want, n - 1)})
        return found[own]

    kind = items.schema["y"].dataType.simpleString()
    with_r = halo.groupBy(*by, "block").applyInPandas(radii, f"feature string, y {kind}, x double, n long, size long, r double, k long")
    end = lambda v, order, sign: F.struct(v.alias("v"), F.lit(order).alias("o"), F.lit(sign).cast("long").alias("sign"), F.lit(0).cast("long").alias("w"))
    # below x + r and not up to x - r; for r = 0 up to x and not below x, less the row itself
    x, r = F.col("x"), F.col("r")
    asked = F.when(r > 0, F.array(end(x + r, 0, 1), end(x - r, 2, -1))).otherwise(F.array(end(x, 2, 1), end(x, 0, -1)))
    queries = with_r.select("feature", "y", "x", F.explode(asked).alias("q")).select("feature", "y", "x", "q.*")
    data = cells.groupBy("feature", "x").agg(F.sum("n").alias("w")).select(
        "feature", F.lit(None).cast(kind).alias("y"), F.lit(None).cast("double").alias("x"), F.col("x").alias("v"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("sign"), "w"
    )
    line = bucketed(queries.unionByName(data), "v")
    sums = F.sum("w").over(Window.partitionBy("feature", "bucket").orderBy("v", "o").rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = line.groupBy("feature", "bucket").agg(F.sum("w").alias("t")).select("feature", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    counted = line.withColumn("s", sums).filter("sign IS NOT NULL").join(F.broadcast(base), ["feature", "bucket"])  # features times buckets
    m = counted.groupBy("feature", "y", "x").agg(F.sum(F.col("sign") * (F.col("s") + F.col("base"))).alias("m"))
    both = with_r.join(m, ["feature", "y", "x"]).withColumn("m", F.when(F.col("r") > 0, F.col("m")).otherwise(F.col("m") - 1))
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / F.sum("n")
    mi = digamma(F.sum("n")) + mean("k") - mean("size") - mean("m")
    return both.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def mutual_information(df: DataFrame, target: str, features: list[str], neighbours: int = 3) -> DataFrame:
    """Rows (feature, mi) in nats: nearest neighbours between a number and a class, counts between classes, bins between numbers."""
    rows = df.filter(name(target).isNotNull())
    numbers, texts = [c for c in features if is_numeric(df, c)], [c for c in features if not is_numeric(df, c)]
    if is_numeric(df, target):
        mixed, plain, pairs = texts, [], numbers
        item = lambda c: (name(target).cast("double"), name(c).cast("string"))
    else:
        mixed, plain, pairs = numbers, texts, []
        item = lambda c: (name(c).cast("double"), name(target).cast("string"))
    out = []
    if mixed:
        items = F.array(*(F.struct(F.lit(c).alias("feature"), item(c)[0].alias("x"), item(c)[1].alias("y")) for c in mixed))
        out.append(nearest_information(rows.select(F.explode(items).alias("i")).select("i.*").dropna(), neighbours))
    if plain:
        items = F.array(*(F.struct(F.lit(c).alias("feature"), name(c).cast("string").alias("x"), name(target).cast("string").alias("y")) for c in plain))
        cells = rows.select(F.explode(items).alias("i")).select("i.*").dropna().groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("o"))
        out.append(_plug_in(cells))
    if pairs:
        out.append(binned_information(rows, target, pairs))
    first, *rest = out
    for r in rest:
        first = first.unionByName(r)
    return first


def combined_rank(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows (feature, combined_rank): mean of the ranks by each table's value, largest first."""
    out = None
    for k, (df, value) in tables.items():
        r = df.select("feature", F.row_number().over(Window.orderBy(F.col(value).desc_nulls_last(), "feature")).alias(k))  # one row per feature
        out = r if out is None else out.join(r, "feature")
    mean = sum((F.col(k) for k in tables), F.lit(0)) / F.lit(len(tables))
    return out.select("feature", mean.cast("double").alias("combined_rank"))


def recommendations(importance: DataFrame, features: int) -> DataFrame:
    """Add keep, drop or review. importance: feature, importance, mi, missing_pct."""
    uniform = 1.0 / max(1, features)
    drop = (F.col("importance") < 0.3 * uniform) & (F.col("mi") < 0.005) | (F.col("missing_pct") > 30) & (F.col("importance") < uniform)
    return importance.withColumn("recommendation", F.when(drop, "drop").when(F.col("importance") > 2.5 * uniform, "keep").otherwise("review"))


def warnings(df: DataFrame, target: str) -> DataFrame:
    """Rows (kind, subject, value): imbalance, missing features, few rows."""
    top = class_distribution(df, target, 1).filter("pct > 65").select(
        F.when(F.col("pct") > 80, "severe_imbalance").otherwise("imbalance").alias("kind"), F.col("value").alias("subject"),
        F.col("pct").alias("value")
    )
    gaps = feature_metadata(df, target).filter("missing_pct > 20").select(
        F.lit("missing").alias("kind"), F.col("feature").alias("subject"), F.col("missing_pct").alias("value")
    )
    few = df.filter(name(target).isNotNull()).agg(F.count(F.lit(1)).cast("double").alias("value")).filter("value < 100").select(
        F.lit("few_rows").alias("kind"), F.lit(target).alias("subject"), "value"
    )
    return top.unionByName(gaps).unionByName(few)


def leakage(found: DataFrame) -> DataFrame:
    """Features suspiciously close to the target."""
    return found.filter("strength >= 0.9").select("feature", "strength", F.when(F.col("strength") >= 0.97, "high").otherwise("medium").alias("risk"))


def redundant_groups(df: DataFrame, features: list[str], least: float = 0.9, most: int = 20) -> DataFrame:
    """Rows (feature, group_id, strength): numeric features tied by |r| >= least, at most ``most`` of them.

    The group is named by its smallest feature; pairs come from one aggregate, and
    the at most ``most`` names are then merged on the driver.
    """
    used = features[:most]
    links = _pairs(df, [(a, b, correlation(name(a), name(b))) for a, b in numeric_pairs(used)], ("a", "b"), "r").filter(F.abs("r") >= least).collect()
    group = {c: c for c in used}
    for r in sorted(links, key=lambda r: (r["a"], r["b"])):
        x, y = sorted((group[r["a"]], group[r["b"]]))
        group = {k: x if v == y else v for k, v in group.items()}
    best = {g: max(abs(r["r"]) for r in links if group[r["a"]] == g) for g in {group[r["a"]] for r in links}}
    made = [(c, g, float(best[g])) for c, g in group.items() if g in best]
    return df.sparkSession.createDataFrame(made, "feature string, group_id string, strength double")


# --- models ------------------------------------------------------------------------------------


def forest(classification: bool, trees: int = 25, depth: int = 10, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    return (RandomForestClassifier if classification else RandomForestRegressor)(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64)


def forest_importance(matrix: DataFrame, names: list[str], classification: bool, trees: int = 25, depth: int = 10) -> DataFrame:
    """Rows (feature, importance), summing to 1."""
    model = forest(classification, trees, depth).fit(matrix)
    made = [(c, float(v)) for c, v in zip(names, model.featureImportances.toArray())]
    return matrix.sparkSession.createDataFrame(made, "feature string, importance double")


def metric(scored: DataFrame, classification: bool) -> Column:
    """Accuracy or R squared as an aggregate."""
    if classification:
        return F.avg((F.col("prediction") == F.col("label")).cast("double"))
    d = F.col("label") - F.col("prediction")
    return 1 - F.try_divide(F.sum(d * d), F.var_pop("label") * F.count(F.lit(1)))


def cross_validate(matrix: DataFrame, classification: bool, keys: list[str], folds: int = 3, **forest_args) -> DataFrame:
    """Rows (fold, score); folds by a hash of the keys, within each class."""
    fold = F.pmod(F.xxhash64(*(name(k) for k in keys), *(["label"] if classification else [])), F.lit(folds)).cast("int")
    rows = matrix.select("features", "label", fold.alias("fold"))
    out = []
    for k in range(folds):
        model = forest(classification, **forest_args).fit(rows.filter(F.col("fold") != k))
        out.append(model.transform(rows.filter(F.col("fold") == k)).agg(F.lit(k).alias("fold"), metric(rows, classification).alias("score")))
    first, *rest = out
    for r in rest:
        first = first.unionByName(r)
    return first


#: Rows among which values are dealt out anew.
DEALT_ROWS = 50_000


def permutation_importance(model, matrix: DataFrame, names: list[str], classification: bool, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Rows (feature, mean, std): loss of score when one feature's values are dealt out anew.

    All features and repeats are scored in one job: a replicate column marks them.
    Values are dealt by joining row numbers in two hash orders inside buckets.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    buckets = max(1, -(-matrix.count() // DEALT_ROWS))  # follows from the rows alone, not from the cluster
    rows = matrix.select(vector_to_array("features").alias("x"), "label").withColumn("id", F.xxhash64("x", "label"))
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("bucket", F.pmod("id", F.lit(buckets)))
    one = reps.withColumn("rn", F.row_number().over(Window.partitionBy("rep", "bucket").orderBy("id", "label")))
    two = reps.select(
        "rep", "bucket", F.col("x").alias("other"),
        F.row_number().over(Window.partitionBy("rep", "bucket").orderBy(F.xxhash64("id", "rep", F.lit(seed)), "id")).alias("rn")
    )
    both = one.join(two, ["rep", "bucket", "rn"]).withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))))
    mixed = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.element_at("other", i + 1)).otherwise(v))
    scored = model.transform(both.select("rep", "j", "label", array_to_vector(mixed).alias("features")))
    s = scored.groupBy("rep", "j").agg(metric(scored, classification).alias("score"))
    base = s.filter("j = -1").select("rep", F.col("score").alias("base"))
    loss = s.filter("j >= 0").join(F.broadcast(base), "rep").groupBy("j").agg(
        F.avg(F.col("base") - F.col("score")).alias("mean"), F.stddev_pop(F.col("base") - F.col("score")).alias("std")
    )
    labels = F.array(*map(F.lit, names))
    return loss.select(F.element_at(labels, F.col("j") + 1).alias("feature"), "mean", "std")


METHODS: dict[str, Callable] = {"mi": mutual_information, "correlation": associations}


def feature_importance(df: DataFrame, target: str, methods: tuple[str, ...] = ("mi", "correlation")) -> dict[str, DataFrame]:
    """Only the tables asked for, lazily."""
    features = [c for c in df.columns if c != target]
    out = {"problem": problem_type(df, target), "metadata": feature_metadata(df, target)}
    for m in methods:
        out[m] = METHODS[m](df, target, features)
    return out


