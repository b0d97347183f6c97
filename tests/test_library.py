"""Golden, differential and property tests of the library."""

from __future__ import annotations

import json
import math
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import dist
from tidewell.operators import assoc, charts, importance, joins, outliers, predicates, profile, rules, series, steps, tests_stat, text, udf
from tidewell.plans.sqlspace import Workspace, is_read_only, slug, statements
from tidewell.sources import io, rest
from tidewell.streaming import streams


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- distributions ---------------------------------------------------------------------


def test_distribution_tails():
    assert dist.f_upper(3, 2, 30) == pytest.approx(1 - 0.9350945285, abs=1e-9)
    assert dist.t_two_sided(2, 10) == pytest.approx(2 * (1 - 0.9633059826), abs=1e-9)
    assert dist.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert dist.kolmogorov_upper(1.3580986) == pytest.approx(0.05, abs=1e-4)


def test_distributions_match_another_library(spark):
    m = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for a, b, x in ((1, 3, 0.5), (2, 30, 3.0), (10, 7, 1.2), (40, 55, 0.8)):
        assert dist.f_upper(x, a, b) == pytest.approx(1 - m.FDistribution(float(a), float(b)).cumulativeProbability(x), abs=1e-9)
    for k, x in ((1, 0.3), (4, 9.0), (30, 22.0)):
        assert dist.chi2_upper(x, k) == pytest.approx(1 - m.ChiSquaredDistribution(float(k)).cumulativeProbability(x), abs=1e-9)


# --- rows and steps -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": range(60), "x": rng.normal(size=60).round(3), "g": rng.choice(["a", "b", None], 60)})
    x.loc[::7, "x"] = None
    return x


def test_steps_match_pandas(spark, frame):
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k long, x double, g string")
    got = steps.fill(df, "x", "median").orderBy("k").toPandas()["x"]
    assert np.allclose(got, frame["x"].fillna(frame["x"].median()))
    got = steps.fill(df, "x", "ffill", order_by="k").orderBy("k").toPandas()["x"]
    assert np.allclose(got, frame["x"].ffill(), equal_nan=True)
    got = steps.bins(df.dropna(subset=["x"]), "x", 5).orderBy("k").toPandas()["x_bin"]
    assert (got.to_numpy() == pd.cut(frame["x"].dropna(), 5, labels=False).to_numpy()).all()
    got = steps.label_encode(df, "g", -1).orderBy("k").toPandas()["g"]
    assert (got.to_numpy() == frame["g"].astype("category").cat.codes.to_numpy()).all()


def test_pipeline_logs_and_goes_on(spark, frame):
    df = spark.createDataFrame(frame[["k"]])
    out, log = steps.run_pipeline(df, [
        {"type": "drop_columns", "columns": ["zzz"]}, {"type": "nothing"}, {"type": "rename_column", "column": "no", "new_name": "k2"},
        {"type": "create_column", "new_name": "d", "expression": "k * 2"}
    ])
    assert out.columns == ["k", "d"] and len(log) == 2
    assert steps.check_steps([{"type": "clip", "colum": "x"}])


def test_predicates_keep_nulls_only_for_inequality(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    assert pairs(predicates.apply_filters(df, [{"column": "v", "operator": "!=", "value": "a"}]), "k") == [(2,), (3,)]
    assert pairs(predicates.apply_filters(df, [{"column": "v", "operator": "not_contains", "value": "a"}]), "k") == [(2,), (3,)]
    with pytest.raises(ValueError):
        predicates.condition("v", "near", 1)


def test_joins_match_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "k int, v string")
    assert [tuple(r) for r in joins.join_datasets(a, b, "inner", ["k"], ["k"]).collect()] == [(None, "y", "z")]
    assert joins.join_datasets(a, b, "outer", ["k"], ["k"]).count() == 3


def test_asof_join_matches_pandas(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.integers(0, 3, 40), "t": np.sort(rng.integers(0, 1000, 40))})
    right = pd.DataFrame({"k": rng.integers(0, 3, 30), "t": np.sort(rng.permutation(1000)[:30]), "v": rng.normal(size=30)})
    want = pd.merge_asof(left, right, on="t", by="k")
    got = joins.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "t", ["k"], ["v"])
    assert sorted((r.k, r.t, r.v or 0) for r in got.collect()) == sorted(
        (k, t, 0 if math.isnan(v) else v) for k, t, v in want[["k", "t", "v"]].itertuples(index=False)
    )


# --- statistics -----------------------------------------------------------------------------


def test_constant_columns_do_not_break_profiles(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 3.0, None)], "a int, b double, c string")
    kinds = dict(pairs(profile.column_profile(df), "column_name", "semantic_type"))
    assert kinds["a"] == "constant" and kinds["c"] == "constant"
    assert pairs(assoc.pearson(df, ["a", "b"]), "r") == [(None,)]
    assert profile.column_profile(df.limit(0)).count() == 3


def test_vif_finds_collinearity(spark):
    df = spark.range(200).selectExpr("cast(id % 7 as double) a", "cast(id % 11 as double) b").withColumn("c", F.col("a") + F.col("b") + F.rand(3) / 10)
    v = dict(pairs(assoc.vif(df), "column_name", "vif"))
    assert v["c"] > 100 and v["a"] > 10


def test_shapiro_tells_normal_from_skewed(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame(pd.DataFrame({"n": rng.normal(size=300), "e": rng.exponential(size=300)}))
    assert tests_stat.shapiro(df, "n").first()["p"] > 0.01
    assert tests_stat.shapiro(df, "e").first()["p"] < 1e-6


def test_rank_tests_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"v": rng.integers(0, 12, 80).astype(float), "g": rng.choice(["a", "b"], 80)})
    a, b = x.v[x.g == "a"].to_numpy(), x.v[x.g == "b"].to_numpy()
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert tests_stat.mann_whitney(spark.createDataFrame(x), "v", "g", "a", "b").first()["u"] == u
    s = assoc.spearman(spark.createDataFrame(x.assign(w=rng.normal(size=80))), "v", "w").first()["r"]
    assert -1 <= s <= 1


def test_isolation_forest_and_noise(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame({"k": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400)})
    x.loc[0, ["a", "b"]] = [9.0, -9.0]
    df = spark.createDataFrame(x)
    found = outliers.isolation_forest(df, ["a", "b"], ["k"], trees=30)
    assert found.orderBy(F.col("score").desc()).first()["k"] == 0
    assert (0,) in pairs(outliers.density_noise(df, ["a", "b"], "k").filter("noise"), "k")


def test_series_tests(spark):
    rng = np.random.default_rng(7)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    shift = np.concatenate((rng.normal(size=150), rng.normal(5, 1, 150)))
    rows = [
        (k, i, float(v)) for k, x in (("noise", noise), ("walk", walk), ("shift", shift), ("sine", np.sin(np.arange(400) * 2 * np.pi / 20))) for i,
        v in enumerate(x)
    ]
    s = spark.createDataFrame(rows, "k string, pos long, value double").withColumn("ts", F.expr("date_add(date'2024-01-01', cast(pos as int))"))
    adf = dict(pairs(series.adf(s, ["k"]), "k", "p"))
    assert adf["noise"] < 0.01 and adf["walk"] > 0.05
    kpss = dict(pairs(series.kpss(s, ["k"]), "k", "p"))
    assert kpss["noise"] > 0.05 and kpss["walk"] < 0.05
    cuts = [r.pos for r in series.mean_shifts(s.filter("k = 'shift'"), ["k"]).collect()]
    assert any(abs(c - 150) < 5 for c in cuts)
    period = dict(pairs(series.seasonal_period(series.autocorrelation(s, ["k"]), ["k"]), "k", "period"))
    assert period["sine"] in (20, 40)
    assert series.spectrum(s.filter("k = 'sine'"), ["k"]).filter("rank = 1").first()["period"] == pytest.approx(20)
    parts = series.stl(s.filter("k = 'sine'"), ["k"], 20).toPandas()
    assert np.allclose(parts.value, parts.trend + parts.seasonal + parts.residual)
    t = dict(pairs(series.cusum_threshold(s.filter("k = 'noise'"), ["k"], alpha=0.5), "k", "threshold"))["noise"]
    assert t < dict(pairs(series.cusum_threshold(s.filter("k = 'noise'"), ["k"], alpha=0.01), "k", "threshold"))["noise"]


def test_granger_finds_the_lagged_cause(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    y = np.concatenate(([0.0], 0.8 * x[:-1])) + 0.3 * rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": range(300), "x": x, "y": y, "z": rng.normal(size=300)}))
    p = dict(pairs(series.granger(df, "t", "y", ["x", "z"], ["k"]), "other", "p"))
    assert p["x"] < 1e-6 and p["z"] > p["x"]


def test_models_add_up(spark):
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": rng.normal(size=150), "b": rng.normal(size=150)})
    x["y"] = 3 * x.a + rng.normal(size=150) / 10
    rows, names = importance.feature_matrix(spark.createDataFrame(x), "y")
    assert importance.forest_importance(rows, names, False, 5, 4).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    model = importance.forest(False, 5, 4).fit(rows)
    loss = dict(pairs(importance.permutation_importance(model, rows, names, False, 2), "feature", "mean"))
    assert loss["a"] > loss["b"]


def test_principal_components(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"k": range(300), "a": a, "b": a + rng.normal(size=300) / 50, "c": rng.normal(size=300)}))
    scores, loadings = charts.principal_components(df, ["a", "b", "c"], 2, ["k"])
    assert scores.count() == 300
    assert loadings.filter("component = 'pc1'").first()["explained"] > 0.6


# --- text, rules, SQL ---------------------------------------------------------------------------


def test_tokens_are_whole_words(spark):
    df = spark.createDataFrame([("Él été the cat_sat on mats2 OK fine",)], "t string")
    assert df.select(text.tokens(F.col("t")).alias("w")).first()["w"] == ["the", "on", "ok", "fine"]


def test_rules_round_trip(spark, tmp_path):
    rs = [{"column_name": "v", "rule_type": "unique", "params": {}}, {"column_name": "v", "rule_type": "not_null", "params": {}}]
    io_path = str(tmp_path / "rules")
    rules.save_rules(rules.rule_table(spark, rs), io_path)
    assert rules.load_rules(spark.read.parquet(io_path)) == rs
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "v string")
    assert pairs(rules.check(df, rs), "rule_id", "fail_count") == [(0, 4), (1, 2)]


def test_sql_scripts(spark):
    assert statements("SELECT ';' AS a; SELECT 2;") == ["SELECT ';' AS a", "SELECT 2"]
    assert is_read_only(" with x as (select 1) select * from x") and not is_read_only("DROP TABLE x")
    assert slug("2024 Sales--(EU)") == "t_2024_sales_eu"
    with pytest.raises(ValueError):
        Workspace(spark, {}).sql("DROP VIEW x", read_only=True)


# --- sources and streams ---------------------------------------------------------------------------


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_are_sniffed(spark, tmp_path, sep):
    p = tmp_path / "x.dat"
    p.write_text("\n".join(sep.join(r) for r in (["a", "b"], ["1", "x y"], ["2", "z"])))
    df = io.read_dataset(spark, str(p))
    assert df.columns == ["a", "b"] and df.agg(F.sum("a")).first()[0] == 3


def test_json_is_flattened(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps([{"a": {"b": 1, "c": {"d": "x"}}, "l": [1, 2]}]))
    assert sorted(io.read_dataset(spark, str(p)).columns) == ["a.b", "a.c.d", "l"]


def test_jdbc_with_the_embedded_database(spark, tmp_path):
    url = f"jdbc:derby:memory:t{abs(hash(str(tmp_path)))};create=true"
    spark.range(10).selectExpr("id", "id * 2 AS twice").write.format("jdbc").option("url", url).option("dbtable", "numbers").option(
        "driver", io.SOURCES["derby"][1]["driver"]
    ).save()
    opts = {"driver": io.SOURCES["derby"][1]["driver"]}
    assert io.read_jdbc(spark, url, "numbers", partition=("id", 0, 10, 2), **opts).count() == 10
    assert io.read_jdbc(spark, url, query='SELECT "twice" FROM numbers WHERE "id" > 7;', limit=1, **opts).count() == 1
    assert ("NUMBERS",) in pairs(io.list_tables(spark, "derby", url, **opts), "TABLE_NAME")


def test_rest_source_follows_pages(spark):
    class Stub(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2] or 0)
            ok = self.headers.get("Authorization") == "Bearer T"
            body = {"data": {"rows": [{"id": page * 2 + i, "in": {"x": i}} for i in range(2)] if ok else []}, "next": f"/?p={page + 1}" if page < 2 else None}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.RestSource)
    url = f"http://127.0.0.1:{server.server_port}/?p=0"
    df = spark.read.format("rest_json").options(urls=url, auth="bearer:T", json_path="data.rows", next_field="next").load()
    got = rest.records(df)
    assert sorted(got.columns) == ["id", "in.x"] and sorted(r["id"] for r in got.collect()) == list(range(6))
    server.shutdown()


def test_fingerprint_ignores_row_order(spark):
    df = spark.range(50).selectExpr("id", "cast(id % 3 as string) s")
    a, b = io.fingerprint(df).first(), io.fingerprint(df.orderBy(F.rand(1))).first()
    assert a == b and io.fingerprint(df.unionByName(df.limit(1))).first() != a


def test_stream_counts_equal_batch(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "timestampadd(MINUTE, id * 7, timestamp'2024-01-01') AS ts")
    df.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    s = streams.read_files(spark, str(tmp_path / "in"), df.schema)
    streams.run_once(streams.counts_per_window(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = dict(pairs(spark.read.schema("start timestamp, n long").parquet(str(tmp_path / "out")), "start", "n"))
    want = {r["d"]: r["n"] for r in df.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 1


def test_incremental_refresh(spark, tmp_path):
    df = spark.range(30).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.refresh(streams.read_files(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "runs"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "runs")).first()["row_count"] == 30


def test_user_functions(spark):
    out = udf.map_groups(spark.range(10).selectExpr("id % 2 AS g", "id"), ["g"], lambda p: p.groupby("g", as_index=False).sum(), "g long, id long")
    assert pairs(out, "g", "id") == [(0, 20), (1, 25)]


def test_exact_quantiles_equal_percentile(spark):
    """Beyond the size from which brackets are narrow, with repeated values, nulls and two groups."""
    from tidewell.operators.ranks import exact_quantiles

    df = spark.range(60_000).selectExpr(
        "id % 2 AS g", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN 5.0 ELSE CAST(pmod(hash(id), 100003) AS DOUBLE) END AS x"
    )
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], F.col("x"), points).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, points))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(a == pytest.approx(b) for g in want for a, b in zip(got[g], want[g]))
    few = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "x double")
    assert exact_quantiles(few, [], F.col("x"), [0.99]).first()["q"] == pytest.approx([3.96])
    assert exact_quantiles(few.limit(0), [], F.col("x"), [0.5]).first()["q"] == [None]


@pytest.mark.parametrize("cell_rows", [100_000, 3])
def test_kendall_in_buckets(spark, cell_rows):
    import random

    from tidewell.operators.assoc import kendall

    r = random.Random(2)
    rows = [(float(r.randint(0, 40)), float(r.randint(0, 25)) if r.random() < 0.6 else float(r.randint(0, 40))) for _ in range(300)]
    s = sum((a[0] > b[0]) - (a[0] < b[0]) if a[1] > b[1] else (a[0] < b[0]) - (a[0] > b[0]) if a[1] < b[1] else 0 for i, a in enumerate(rows) for b in rows[:i])
    pairs = len(rows) * (len(rows) - 1) / 2
    tie = lambda k: sum(n * (n - 1) / 2 for n in Counter(x[k] for x in rows).values())
    got = kendall(spark.createDataFrame(rows, "a double, b double"), "a", "b", cell_rows).first()
    assert got["tau"] == pytest.approx(s / ((pairs - tie(0)) * (pairs - tie(1))) ** 0.5) and got["n"] == 300


def test_positions_follow_the_order(spark):
    from tidewell.operators.ranks import positions

    df = spark.range(3000).selectExpr("hash(id) AS v", "id")
    got = [r["id"] for r in positions(df, F.struct("v", "id"), "n", 16).orderBy("n").collect()]
    assert got == [r["id"] for r in df.orderBy("v", "id").collect()]


def test_guard_refuses_inserts_behind_with(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW guarded AS SELECT 1 AS a")
    w = Workspace(spark, {"one": spark.range(1)})
    for text in ("WITH q AS (SELECT 1 a) INSERT INTO guarded SELECT a FROM q", "INSERT INTO guarded SELECT 2", "DROP VIEW guarded"):
        with pytest.raises(ValueError, match="only SELECT"):
            w.sql(text, read_only=True)
    assert w.sql("WITH q AS (SELECT id FROM one) SELECT 'Insert' AS t FROM q", read_only=True).count() == 1


def test_fingerprint_of_many_rows(spark):
    from tidewell.sources.io import fingerprint

    assert fingerprint(spark.range(0, 20_000_000, 1, 8)).first()["rows"] == 20_000_000


def test_normality_chooses_by_length(spark):
    from tidewell.operators.tests_stat import normality, shapiro

    df = spark.range(6000).selectExpr("CASE WHEN id < 20 THEN 'a' WHEN id < 25 THEN 'b' ELSE 'c' END AS k", "CAST(pmod(hash(id), 1009) AS DOUBLE) AS value")
    got = {r["k"]: r for r in normality(df, ["k"]).collect()}
    assert got["a"]["test"] == "shapiro" and got["c"]["test"] == "dagostino" and "b" not in got
    one = shapiro(df.filter("k = 'a'"), "value").first()
    assert got["a"]["statistic"] == pytest.approx(one["w"]) and not one["sampled"]
    many = [shapiro(df.repartition(n), "value", 500).first() for n in (2, 7)]
    assert many[0] == many[1] and many[0]["sampled"] and 400 < many[0]["n"] < 600


def test_full_analysis_bundles(spark):
    df = spark.range(400).selectExpr(
        "id", "CAST(pmod(hash(id), 97) AS DOUBLE) AS x", "CAST(id * 2 AS DOUBLE) AS y", "IF(id % 2 = 0, 'a', 'b') AS g",
        "timestamp_seconds(id * 86400) AS ts"
    )
    found = charts.full_analysis(df)
    assert {"missing", "quality", "correlation", "scatter", "outliers", "normality", "grouped_box"} <= set(found)
    r = {(x["column_a"], x["column_b"]): x["r"] for x in found["correlation"].collect()}
    assert r["id", "y"] == pytest.approx(1.0)
    assert {x["column_name"] for x in found["normality"].collect()} == {"id", "x", "y"}
    kinds = [set(charts.column_analysis(df, c)) for c in ("x", "g", "ts")]
    assert "histogram" in kinds[0] and "bars" in kinds[1] and "seasonality" in kinds[2]
