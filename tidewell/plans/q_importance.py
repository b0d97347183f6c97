"""Queries of group K (feature importance)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import forests as T
from tidewell.operators import importance as K

from .fixtures import t
from .registry import query


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_F = "f AS (SELECT quality, length(text) AS len, len(string_split(text, ' ')) AS words, len(string_split(text, chr(10))) AS lines, lang, d.doc_id % 2 AS odd FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_W = f"WITH {_F} "


def _features(spark, d):
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return docs.selectExpr(
        "quality", "cast(length(text) as bigint) AS len", "cast(size(split(text, ' ')) as bigint) AS words",
        "cast(size(split(text, '\\n')) as bigint) AS lines", "lang", "doc_id % 2 AS odd"
    )


def _cls(spark, d):
    return _features(spark, d).withColumn("quality", F.col("quality").cast("string"))


def _matrix(spark, d, classification):
    """The matrix of features that are taken from the texts once and written out, as a forest's rows are read many times."""
    from .q_sources import _scratch

    path = _scratch(spark, "features")
    (_cls if classification else _features)(spark, d).write.parquet(path)
    return K.feature_matrix(spark.read.parquet(path), "quality")


@query(
    "k01_problem_type",
    "SELECT 'regression' AS problem_type, count(DISTINCT o_totalprice) AS classes, count(*) AS rows FROM orders UNION ALL SELECT 'classification', count(DISTINCT quality), count(*) FROM labels"
)
def k01(spark, d):
    return K.problem_type(t(spark, d, "orders"), "o_totalprice").unionByName(K.problem_type(t(spark, d, "labels"), "quality"))


@query(
    "k02_class_distribution",
    "SELECT CAST(quality AS VARCHAR) AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM labels), 4) AS pct FROM labels GROUP BY 1"
)
def k02(spark, d):
    return _r(K.class_distribution(t(spark, d, "labels"), "quality"), 4, "pct")


@query(
    "k03_feature_matrix",
    f"{_W}SELECT 5 AS width, CAST(rank() OVER (ORDER BY quality) - 1 AS DOUBLE) AS label, n FROM (SELECT CAST(quality AS VARCHAR) AS quality, count(*) AS n FROM f GROUP BY 1)"
)
def k03(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows, names = K.feature_matrix(_cls(spark, d), "quality")
    return rows.select(F.size(vector_to_array("features")).alias("width"), "label").groupBy("width", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k04_feature_metadata",
    f"{_W}SELECT 'len' AS feature, 'bigint' AS dtype, 0.0::DOUBLE AS missing_pct, count(DISTINCT len) AS distinct_n FROM f UNION ALL SELECT 'words', 'bigint', 0.0, count(DISTINCT words) FROM f UNION ALL SELECT 'lines', 'bigint', 0.0, count(DISTINCT lines) FROM f UNION ALL SELECT 'lang', 'string', 0.0, count(DISTINCT lang) FROM f UNION ALL SELECT 'odd', 'bigint', 0.0, count(DISTINCT odd) FROM f"
)
def k04(spark, d):
    return K.feature_metadata(_features(spark, d), "quality")


@query("k05_forest_importance")
def k05(spark, d):
    rows, names = K.feature_matrix(_cls(spark, d), "quality")
    return K.forest_importance(rows, names, True)


@query("k06_out_of_bag")
def k06_oob(spark, d):
    rows, names = _matrix(spark, d, True)
    data = T.binned(rows, names, True)
    model = T.grow(rows, names, True, rows=data)
    return T.held_out_scores(model, data[0]).select("score", "n")


@query("k06_cross_validation")
def k06(spark, d):
    rows, _ = K.feature_matrix(_cls(spark, d), "quality")
    return K.cross_validate(rows, True, ["len", "words"])


_PSI = "psi AS (SELECT i, -0.5772156649015329 + coalesce(sum(1.0 / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM f))) AS i))"


def _mi(c, numeric):
    if not numeric:
        return f"SELECT '{c}' AS feature, round(sum(o / n * ln(o * n / (px * py))), 6) AS mi FROM (SELECT o, sum(o) OVER (PARTITION BY x) AS px, sum(o) OVER (PARTITION BY y) AS py, sum(o) OVER () AS n FROM (SELECT {c} AS x, quality AS y, count(*)::DOUBLE AS o FROM f GROUP BY 1, 2))"
    p = f"(SELECT row_number() OVER () AS id, CAST({c} AS DOUBLE) AS x, quality AS y FROM f)"
    near = f"SELECT a.id, a.x, a.y, abs(a.x - b.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x - b.x)) AS place, count(*) OVER (PARTITION BY a.id) AS others FROM {p} a JOIN {p} b ON a.y = b.y AND a.id <> b.id"
    r = f"SELECT id, any_value(x) AS x, any_value(others) + 1 AS size, max(CASE WHEN place = least(3, others) THEN d END) AS r, count(*) FILTER (d = 0) AS same, least(3, any_value(others)) AS k FROM ({near}) GROUP BY id"
    m = f"SELECT r.id, any_value(size) AS size, CASE WHEN any_value(r) > 0 THEN any_value(k) ELSE any_value(same) END AS k, CASE WHEN any_value(r) > 0 THEN count(*) FILTER (p.x < r.x + r AND p.x > r.x - r) ELSE count(*) FILTER (p.x = r.x) - 1 END AS m FROM ({r}) r, {p} p GROUP BY r.id"
    return f"SELECT '{c}' AS feature, round(greatest(0, any_value(w.psi) + avg(a.psi) - avg(b.psi) - avg(e.psi)), 6) AS mi FROM (SELECT *, count(*) OVER () AS whole FROM ({m})) q JOIN psi w ON w.i = q.whole JOIN psi a ON a.i = q.k JOIN psi b ON b.i = q.size JOIN psi e ON e.i = q.m"


_MI = " UNION ALL ".join([_mi("len", True), _mi("words", True), _mi("lines", True), _mi("lang", False), _mi("odd", True)])


@query("k07_mutual_information", f"{_W.rstrip()}, {_PSI} {_MI}")
def k07(spark, d):
    return _r(K.mutual_information(_cls(spark, d), "quality", ["len", "words", "lines", "lang", "odd"]), 6, "mi")


def _assoc(c):
    return f"SELECT '{c}' AS feature, 'pearson' AS method, round(abs(corr({c}, o_totalprice)), 6) AS strength, round(power(corr({c}, o_totalprice), 2) * (count(*) - 2) / (1 - power(corr({c}, o_totalprice), 2)), 4) AS f_score FROM orders"


_AS = f"{_assoc('o_orderkey')} UNION ALL {_assoc('o_custkey')} UNION ALL SELECT 'o_orderpriority', 'eta', round(sqrt(sum(n * power(m - am, 2)) / any_value(sst)), 6), round((sum(n * power(m - am, 2)) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))), 4) FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS v FROM orders GROUP BY 1), (SELECT avg(o_totalprice) AS am, var_pop(o_totalprice) * count(*) AS sst FROM orders)"


def _orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


@query("k08_associations", f"SELECT feature, method, strength FROM ({_AS})")
def k08(spark, d):
    return _r(K.associations(_orders(spark, d), "o_totalprice"), 6, "strength").drop("f_score")


@query("k09_f_score", f"SELECT feature, f_score FROM ({_AS})")
def k09(spark, d):
    return _r(K.associations(_orders(spark, d), "o_totalprice"), 4, "f_score").select("feature", "f_score")


@query(
    "k10_combined_rank",
    f"WITH a AS ({_AS}), s AS (SELECT feature, row_number() OVER (ORDER BY strength DESC, feature) AS x, row_number() OVER (ORDER BY f_score DESC, feature) AS y FROM a) SELECT feature, (x + y) / 2 AS combined_rank FROM s"
)
def k10(spark, d):
    a = K.associations(_orders(spark, d), "o_totalprice")
    return K.combined_rank({"x": (a, "strength"), "y": (a, "f_score")})


@query(
    "k11_recommendations",
    f"{_W.rstrip()}, {_PSI}, m AS ({_MI}) SELECT feature, CASE WHEN mi / (SELECT sum(mi) FROM m) < 0.3 / 5 AND mi < 0.005 THEN 'drop' WHEN mi / (SELECT sum(mi) FROM m) > 2.5 / 5 THEN 'keep' ELSE 'review' END AS recommendation FROM m"
)
def k11(spark, d):
    m = K.mutual_information(_cls(spark, d), "quality", ["len", "words", "lines", "lang", "odd"])
    m = m.crossJoin(F.broadcast(m.agg(F.sum("mi").alias("all")))).select(
        "feature", (F.col("mi") / F.col("all")).alias("importance"), "mi", F.lit(0.0).alias("missing_pct")
    )
    return K.recommendations(m, 5).select("feature", "recommendation")


@query(
    "k12_warnings",
    "SELECT CASE WHEN pct > 80 THEN 'severe_imbalance' ELSE 'imbalance' END AS kind, value AS subject, round(pct, 4) AS value FROM (SELECT CAST(quality AS VARCHAR) AS value, 100.0 * count(*) / (SELECT count(*) FROM labels) AS pct FROM labels GROUP BY 1 ORDER BY count(*) DESC LIMIT 1) WHERE pct > 65 UNION ALL SELECT 'few_rows', 'quality', count(*) FROM labels HAVING count(*) < 100"
)
def k12(spark, d):
    return _r(K.warnings(t(spark, d, "labels").withColumn("quality", F.col("quality").cast("string")), "quality"), 4, "value")


@query("k13_leakage", "SELECT feature, round(strength, 6) AS strength, CASE WHEN strength >= 0.97 THEN 'high' ELSE 'medium' END AS risk FROM (SELECT 'copy' AS feature, abs(corr(o_totalprice * 1.1 + o_custkey, o_totalprice)) AS strength FROM orders UNION ALL SELECT 'o_orderkey', abs(corr(o_orderkey, o_totalprice)) FROM orders) WHERE strength >= 0.9")
def k13(spark, d):
    df = t(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", "o_totalprice * 1.1 + o_custkey AS copy")
    return _r(K.leakage(K.associations(df, "o_totalprice")), 6, "strength")


@query(
    "k14_redundant_groups",
    "SELECT unnest(['a', 'b', 'c']) AS feature, 'a' AS group_id, round(greatest(abs(corr(a, b)), abs(corr(b, c)), abs(corr(a, c))), 6) AS strength FROM (SELECT l_quantity AS a, 2 * l_quantity + 1 AS b, l_quantity + 10 * l_tax AS c, l_discount AS d FROM lineitem)"
)
def k14(spark, d):
    df = t(spark, d, "lineitem").selectExpr("l_quantity AS a", "2 * l_quantity + 1 AS b", "l_quantity + 10 * l_tax AS c", "l_discount AS d")
    return _r(K.redundant_groups(df, ["a", "b", "c", "d"]), 6, "strength")


@query("k15_permutation_importance")
def k15(spark, d):
    rows, names = K.feature_matrix(_cls(spark, d), "quality")
    return K.permutation_importance(K.forest(True).fit(rows), rows, names, True)


@query("k16_mean_abs_shapley")
def k16(spark, d):
    rows, names = _matrix(spark, d, False)
    data = T.binned(rows, names, False)
    return T.mean_abs_shapley(T.grow(rows, names, False, rows=data), data[0])


@query("k17_stability")
def k17(spark, d):
    rows, names = _matrix(spark, d, True)
    return T.stability(T.grow(rows, names, True, refits=10, kind="bootstrap"), rows)


@query("k18_interactions")
def k18(spark, d):
    rows, names = _matrix(spark, d, False)
    data = T.binned(rows, names, False)
    model = T.grow(rows, names, False, rows=data)
    top = sorted(zip(-T.importances(model)[0], names))[:8]
    return T.interactions(model, data[0], [c for _, c in top])


@query("k19_method_groups", f"{_W.rstrip()}, {_PSI} {_MI}")
def k19(spark, d):
    return _r(K.feature_importance(_cls(spark, d), "quality", ("mi",))["mi"], 6, "mi")
