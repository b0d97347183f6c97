"""Queries of groups A (sources, catalog), Q (streams) and R (user functions)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tidewell.functions.cleaning import sanitize
from tidewell.operators import udf as V
from tidewell.sources import io
from tidewell.streaming import streams

from .fixtures import t
from .registry import query
from .sqlspace import Workspace


def _scratch(spark, label: str) -> str:
    """A new folder below the shared one; a local one only where none is set and Spark runs in local mode."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    base = base or tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidewell-{label}-{uuid.uuid4().hex}"


_ROUND = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _written(spark, d, label: str, fmt: str, **options: str) -> str:
    """The orders as files of another format in the shared folder."""
    path = _scratch(spark, label)
    t(spark, d, "orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS o_orderkey", "o_orderstatus", "o_totalprice"
    ).write.options(**options).format(fmt).save(path)
    return path


def _typed(df):
    return df.selectExpr("CAST(o_orderkey AS BIGINT) AS o_orderkey", "o_orderstatus", "CAST(o_totalprice AS DOUBLE) AS o_totalprice")


@query("a01_csv_scan", _ROUND)
def a01(spark, d):
    """Semicolons, found by the sniffer."""
    return _typed(io.read_dataset(spark, _written(spark, d, "scan", "csv", header="true", sep=";"), "csv"))


@query("a02_tsv_scan", _ROUND)
def a02(spark, d):
    return _typed(io.read_dataset(spark, _written(spark, d, "scan", "csv", header="true", sep="\t"), "tsv"))


@query("a03_json_scan", _ROUND)
def a03(spark, d):
    return _typed(io.read_dataset(spark, _written(spark, d, "scan", "json"), "jsonl"))


@query("a05_unknown_extension", _ROUND)
def a05(spark, d):
    """A folder without an extension is read as delimited text."""
    return _typed(io.read_dataset(spark, _written(spark, d, "scan", "csv", header="true", sep="|")))


def _database(spark, d) -> str:
    """The customers in an embedded database; it lives in one process, so only a local master can read it."""
    import uuid

    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("the embedded database can't be reached by executors")
    url = f"jdbc:derby:memory:tidewell{uuid.uuid4().hex};create=true"
    t(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", "c_acctbal").write.format("jdbc").options(
        url=url, dbtable="customer", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", numPartitions="1"
    ).save()
    return url


_DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query("a07_jdbc_table", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def a07(spark, d):
    """Read in parallel by ranges of the key."""
    top = t(spark, d, "customer").agg(F.max("c_custkey")).first()[0] or 1
    return io.read_jdbc(spark, _database(spark, d), "customer", partition=("c_custkey", 0, top, 4), **_DRIVER)


@query("a08_jdbc_query", "SELECT c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def a08(spark, d):
    text = 'SELECT "c_nationkey", "c_acctbal" FROM customer WHERE "c_acctbal" > 0;'
    return io.read_jdbc(spark, _database(spark, d), query=text, **_DRIVER)


def _bucket(spark, d) -> str:
    """A bucket of an object store that is mounted on the tables' folder: Hadoop's mount table stands in for the store."""
    import hashlib

    conf, view = spark.sparkContext._jsc.hadoopConfiguration(), "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme"
    if conf.get("fs.gs.impl") not in (None, view):
        raise ValueError("this session has an object store of that kind already")
    bucket = "tables" + hashlib.md5(d.encode()).hexdigest()[:12]
    conf.set("fs.gs.impl", view)
    conf.set("fs.viewfs.overload.scheme.target.gs.impl", "org.apache.hadoop.fs.LocalFileSystem")
    conf.set(f"fs.viewfs.mounttable.{bucket}.link./tables", d if "://" in d else f"file:{d}")
    return bucket


@query("a10_object_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000")
def a10(spark, d):
    """Columns and filter reach the scan of the object."""
    found = io.read_dataset(spark, io.object_uri("gcs", _bucket(spark, d), "/tables/orders.parquet"))
    return found.filter("o_totalprice > 1000").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("a11_rest_pages", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_acctbal FROM supplier")
def a11(spark, d):
    """The suppliers as pages of a local service, each naming the next; read whole, then stored, before the service ends."""
    import json
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    from tidewell.sources import rest

    rows = t(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS s_suppkey", "s_acctbal")
    pages = [json.dumps({"data": {"rows": [r.asDict() for r in part]}}) for part in rest.paged(rows, 200)]

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            i = int(self.path.rsplit("/", 1)[-1])
            page = json.loads(pages[i]) | ({"next": f"/page/{i + 1}"} if i + 1 < len(pages) else {})
            self.send_response(200 if self.headers.get("Authorization") == "Bearer token" else 401)
            self.end_headers()
            self.wfile.write(json.dumps(page).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(rest.RestSource)
        found = spark.read.format("rest_json").options(
            urls=f"http://127.0.0.1:{server.server_port}/page/0", auth="bearer:token", json_path="data.rows", next_field="next"
        ).load()
        return io.save_as(rest.records(found, "s_suppkey long, s_acctbal double"), _scratch(spark, "rest"))
    finally:
        server.shutdown()
        server.server_close()


@query("a12_source_types", _ROUND)
def a12(spark, d):
    return _typed(io.read_dataset(spark, _written(spark, d, "scan", "orc"), "orc"))


@query("a16_export_stored_format", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a16(spark, d):
    path = _scratch(spark, "export")
    io.export(t(spark, d, "orders"), path, "parquet")
    return io.read_dataset(spark, path, "parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a18_copy_dataset", "SELECT c_custkey, c_name FROM customer")
def a18(spark, d):
    return io.copy_dataset(spark, f"{d}/customer.parquet", _scratch(spark, "copy")).select("c_custkey", "c_name")


@query("a04_parquet_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def a04(spark, d):
    return io.read_dataset(spark, f"{d}/lineitem.parquet").filter("l_quantity > 25").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "a06_head",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 100"
)
def a06(spark, d):
    return io.head(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderkey"), 100)


@query("a09_list_objects")
def a09(spark, d):
    return io.list_objects(spark, f"{d}/nation.parquet").select("length")


@query("a13_import_dataset", "SELECT n_nationkey, n_name FROM nation")
def a13(spark, d):
    return io.import_dataset(t(spark, d, "nation").select("n_nationkey", "n_name"), _scratch(spark, "import"))


@query("a14_sanitize", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1) THEN NULL ELSE o_totalprice END AS v FROM orders")
def a14(spark, d):
    return sanitize(t(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') WHEN o_orderkey % 7 = 1 THEN double('Infinity') ELSE o_totalprice END AS v"
    ))


@query("a15_csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a15(spark, d):
    path = _scratch(spark, "csv")
    io.export(t(spark, d, "nation"), path, "csv")
    return io.read_dataset(spark, path, "csv")


@query("a17_save_as", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def a17(spark, d):
    return io.save_as(t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), _scratch(spark, "saved"))


@query("a19_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, '{k}' AS type, count({c}) AS filled, min(CAST({c} AS VARCHAR)) AS example FROM customer" for i,
    (c, k) in enumerate({"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string"}.items())
))
def a19(spark, d):
    return io.describe_with_examples(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")).drop("nullable")


@query("a20_metadata", "SELECT count(*) AS row_count, 2 AS column_count, '{\"r_regionkey\": \"int\", \"r_name\": \"string\"}' AS schema_info FROM region")
def a20(spark, d):
    return io.metadata(t(spark, d, "region"))


@query("a21_fingerprint")
def a21(spark, d):
    return io.fingerprint(t(spark, d, "orders"))


@query(
    "a22_slugs",
    "SELECT p_name, 'my_source__' || CASE WHEN regexp_matches(s, '^[0-9]') THEN 't_' || s WHEN s = '' THEN 't' ELSE s END AS slug FROM (SELECT p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)"
)
def a22(spark, d):
    return io.slugs(t(spark, d, "part").select("p_name"), "p_name", "My Source")


@query("a23_search_columns", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_n FROM {n}" for n,
    c in (("customer", "c_custkey"), ("customer", "c_nationkey"), ("orders", "o_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))
))
def a23(spark, d):
    """The columns found, each with its number of values."""
    from tidewell.operators.profile import distinct_counts

    tables = {n: t(spark, d, n) for n in ("orders", "customer", "part")}
    hits = Workspace(spark, tables).search_columns("key").select("dataset", "column")
    counts = [distinct_counts(df).select(F.lit(n).alias("dataset"), F.col("column_name").alias("column"), "distinct_n") for n, df in tables.items()]
    return hits.join(F.broadcast(counts[0].unionByName(counts[1]).unionByName(counts[2])), ["dataset", "column"])


@query(
    "q01_presence",
    "SELECT event_type, user_id, CAST(last_seen AS VARCHAR) AS last_seen FROM (SELECT user_id, max(ts) AS last_seen, arg_max(event_type, ts) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1) WHERE last_seen >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36000 SECOND"
)
def q01(spark, d):
    return streams.presence_at(t(spark, d, "events"), "2024-01-20 12:00:00", [], "user_id", "event_type", stale=36000)


@query(
    "q02_incremental_refresh",
    "SELECT CAST(7 AS INTEGER) AS dataset_id, count(*) AS row_count, CAST(count(*) = count(DISTINCT event_id) AS INTEGER) AS whole FROM events"
)
def q02(spark, d):
    """All event files that are new, taken by one run of the stream; the history's rows added up."""
    folder, runs = _scratch(spark, "events"), _scratch(spark, "runs")
    t(spark, d, "events").write.parquet(folder)
    streams.refresh(streams.read_files(spark, folder, t(spark, d, "events").schema), runs, _scratch(spark, "offsets"), 7).awaitTermination()
    r = spark.read.parquet(runs)
    return r.groupBy("dataset_id").agg(F.sum("row_count").alias("row_count"), F.min((F.col("quality_score") > 0).cast("int")).alias("whole"))


@query(
    "q03_window_counts",
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"
)
def q03(spark, d):
    """The stream over the events file, run to its end; equal to the daily counts but for the open last window."""
    e = t(spark, d, "events")
    out = _scratch(spark, "stream")
    folder = _scratch(spark, "events")
    e.repartitionByRange(4, "ts").write.parquet(folder)
    s = streams.read_files(spark, folder, e.schema)
    streams.run_once(streams.counts_per_window(s, by=["event_type"]), out, _scratch(spark, "offsets")).awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(out)


@query("q04_rules_on_stream", "SELECT event_id FROM events WHERE value > 100 OR event_type NOT IN ('click', 'view', 'purchase', 'signup')")
def q04(spark, d):
    e = t(spark, d, "events")
    rules = [
        {"column_name": "value", "rule_type": "range", "params": {"max": 100}},
        {"column_name": "event_type", "rule_type": "allowed_values", "params": {"values": ["click", "view", "purchase", "signup"]}}
    ]
    out, folder = _scratch(spark, "quarantine"), _scratch(spark, "events")
    e.write.parquet(folder)
    s = streams.rules_on_stream(streams.read_files(spark, folder, e.schema), rules).select("event_id")
    streams.run_once(s, out, _scratch(spark, "offsets")).awaitTermination()
    return spark.read.schema("event_id long").parquet(out)


@query(
    "q05_sessions",
    "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events FROM (SELECT user_id, sum(CASE WHEN prev IS NULL OR epoch(ts) - epoch(prev) >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY 1, 2"
)
def q05(spark, d):
    return streams.sessions(t(spark, d, "events"), ["user_id"], 1800).select("user_id", "session", "events")


@query("r01_map_batches", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders")
def r01(spark, d):
    def twice(pdf):
        pdf["twice"] = (pdf["o_totalprice"] * 2).round(2)
        return pdf[["o_orderkey", "twice"]]

    return V.map_batches(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), twice, "o_orderkey long, twice double", limit=None)


@query("r02_over_query", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def r02(spark, d):
    return V.over_query(
        Workspace(spark, {"customer": t(spark, d, "customer")}), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", lambda p: p,
        "c_mktsegment string, n long"
    )


@query("r03_python_column", "SELECT c_custkey, length(c_name) * 2 AS v FROM customer")
def r03(spark, d):
    return V.python_column(t(spark, d, "customer"), "v", ["c_name"], lambda s: s.str.len() * 2, "long").select("c_custkey", "v")
