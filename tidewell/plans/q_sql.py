"""Queries of groups D (joins) and E (SQL surface)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import joins as J

from .fixtures import O, orders, t
from .registry import query
from .sqlspace import Workspace, single


@query("d01_join_datasets", f"""{O.rstrip()}, a AS (SELECT prio AS k, o_orderstatus AS s, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1, 2), b AS (SELECT prio AS k, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first FROM o GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, s, a.n AS n_a, b.n AS n_b, first FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def d01(spark, d):
    o = orders(spark, d)
    a = o.groupBy(F.col("prio").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    b = o.groupBy(F.col("prio").alias("k")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return J.join_datasets(a, b, "outer", ["k"], ["k"])


def _tables(spark, d):
    return {n: t(spark, d, n) for n in ("region", "nation", "customer", "orders")}


EDGES = [
    {"source": "orders", "target": "customer", "join_type": "INNER", "source_key": "o_custkey", "target_key": "c_custkey"},
    {"source": "customer", "target": "nation", "join_type": "LEFT", "source_key": "c_nationkey", "target_key": "n_nationkey"},
    {"source": "nation", "target": "region", "join_type": "other", "source_key": "n_regionkey", "target_key": "r_regionkey"},
]


@query(
    "d02_join_graph",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def d02(spark, d):
    return J.join_graph(_tables(spark, d), EDGES).select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "d03_composite_edge",
    "SELECT l.l_orderkey, l.l_linenumber, m.l_tax FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber"
)
def d03(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    edge = {
        "source": "a", "target": "b", "source_key": "l_orderkey", "target_key": "l_orderkey",
        "conditions": [{"source_key": "l_orderkey", "target_key": "l_orderkey"}, {"source_key": "l_linenumber", "target_key": "l_linenumber"}]
    }
    return J.join_graph({"a": li.drop("l_tax"), "b": li}, [edge]).select("l_orderkey", "l_linenumber", "l_tax")


@query("d04_cross_edge", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def d04(spark, d):
    return J.join_graph(_tables(spark, d), [{"source": "region", "target": "nation", "join_type": "LEFT"}]).select("r_name", "n_name")


@query("d05_single_node", "SELECT * FROM nation")
def d05(spark, d):
    return J.join_graph({"nation": t(spark, d, "nation")}, [])


@query(
    "d06_duplicate_names",
    "SELECT a.n_nationkey, a.n_name, b.n_nationkey AS n_nationkey_1, b.n_name AS n_name_1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey"
)
def d06(spark, d):
    n = t(spark, d, "nation")
    return J.join_graph(
        {"a": n, "b": n.drop("n_regionkey")}, [{"source": "a", "target": "b", "source_key": "n_regionkey", "target_key": "n_nationkey"}]
    ).drop("n_regionkey")


@query("d07_limited_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1000")
def d07(spark, d):
    """The limit is the feature; an order makes its rows certain."""
    return J.limited(J.join_graph(_tables(spark, d), EDGES[:1]).select("o_orderkey", "c_name").orderBy("o_orderkey"), 1000)[0]


@query("d08_join_sql", "SELECT count(*) AS n, min(c_name) AS first FROM orders JOIN customer ON o_custkey = c_custkey")
def d08(spark, d):
    ws = Workspace(spark, {k: v for k, v in _tables(spark, d).items() if k in ("orders", "customer")}).register()
    text = J.join_sql({"orders": "orders", "customer": "customer"}, EDGES[:1])
    return ws.spark.sql(f"SELECT count(*) AS n, min(c_name) AS first FROM ({text})")


@query(
    "d09_relationships",
    "SELECT a.n_name AS name_a, b.n_name AS name_b, 'c' || c_custkey AS description, c_custkey AS created_at FROM customer LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_custkey % 30"
)
def d09(spark, d):
    remembered = t(spark, d, "customer").select(
        F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 30).alias("b"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("description"), F.col("c_custkey").alias("created_at")
    )
    return J.relationships(remembered, t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


def _sql(
    name: str, text: str, duck: str | None = None,
    tables: tuple[str, ...] = ("orders", "customer", "lineitem", "nation", "region", "events", "part", "supplier")
) -> None:
    @query(name, duck or text)
    def run(spark, d):
        named = {n: t(spark, d, n) for n in tables if n in text}
        return Workspace(spark, named).sql(text)


@query("e01_single_sql", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def e01(spark, d):
    return single(t(spark, d, "orders"), "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM df GROUP BY 1")


_sql(
    "e02_workspace_sql",
    "SELECT n_name, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
)


@query("e03_script", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def e03(spark, d):
    return Workspace(
        spark, {"customer": t(spark, d, "customer")}
    ).sql("SET spark.sql.session.timeZone=UTC; CREATE OR REPLACE TEMP VIEW rich AS SELECT * FROM customer WHERE c_acctbal > 0; SELECT c_mktsegment, count(*) AS n FROM rich GROUP BY 1;")


@query("e04_read_only", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def e04(spark, d):
    """A WITH query passes the guard; statements that write do not (tested)."""
    return Workspace(spark, {"customer": t(spark, d, "customer")}).sql(
        "WITH x AS (SELECT * FROM customer) SELECT c_mktsegment, count(*) AS n FROM x GROUP BY 1", read_only=True
    )


@query("e05_explain")
def e05(spark, d):
    text = Workspace(spark, {"orders": t(spark, d, "orders")}).explain("SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
    return spark.createDataFrame([(text,)], "plan string")


_sql("e06_equi_join", "SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey")
_sql(
    "e06_theta_join",
    "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a JOIN supplier b ON b.s_acctbal > a.n_nationkey * 400 AND b.s_nationkey < a.n_nationkey"
)
_sql("e06_semi_anti_join", "SELECT c_custkey, 'semi' AS kind FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT c_custkey, 'anti' AS kind FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey",
     "SELECT c_custkey, 'semi' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'anti' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")


@query(
    "e07_asof_join",
    "SELECT l.event_id, l.user_id, r.price FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS price FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts"
)
def e07(spark, d):
    e = t(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("price"))
    return J.asof_join(left, right, "ts", ["user_id"], ["price"]).select("event_id", "user_id", "price")


_sql(
    "e08_group_by",
    "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(avg(l_quantity), 4) AS qty FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10"
)
_sql(
    "e09_grouping_sets",
    "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"
)
_sql("e09_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("e09_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_sql("e10_window", f"""SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(3) OVER w AS BIGINT) AS nt,
round(cume_dist() OVER w, 6) AS cd, round(percent_rank() OVER w, 6) AS pr, lag(o_orderkey) OVER w AS lg, lead(o_orderkey, 2) OVER w AS ld, first_value(o_orderkey) OVER w AS fv, nth_value(o_orderkey, 2) OVER w AS nv,
round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS av FROM orders WINDOW w AS ({_W})""")
_sql("e11_set_operations", "(SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders",
     "(SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) EXCEPT (SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders)")
_sql("e12_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
_sql(
    "e13_subqueries",
    "WITH big AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) SELECT c_custkey, (SELECT count(*) FROM big WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM big b WHERE b.o_custkey = c_custkey) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"
)
_sql("e14_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
     "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
_sql("e14_unpivot", "SELECT l_orderkey, l_linenumber, field, val FROM lineitem UNPIVOT (val FOR field IN (l_discount, l_tax))",
     "SELECT l_orderkey, l_linenumber, 'l_discount' AS field, l_discount AS val FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
_sql("e15_scalars", "SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS u, length(o_orderpriority) AS n, date_format(o_orderdate, 'yyyy-MM') AS m, datediff(o_orderdate, DATE '1992-01-01') AS days, round(pow(o_totalprice, 0.5), 4) AS r, o_orderpriority rlike '^[12]' AS top FROM orders",
     "SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS u, CAST(length(o_orderpriority) AS INTEGER) AS n, strftime(o_orderdate, '%Y-%m') AS m, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, round(pow(o_totalprice, 0.5), 4) AS r, regexp_matches(o_orderpriority, '^[12]') AS top FROM orders")
_sql("e17_approximate", "SELECT approx_count_distinct(o_custkey) AS customers, percentile_approx(o_totalprice, 0.5) AS median FROM orders", " ")
from .registry import ORACLES  # noqa: E402

ORACLES.pop("e17_approximate")


@query("e16_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, len(props) AS n FROM events")
def e16(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query(
    "e16_arrays",
    "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS prios, CAST(len(list_filter(list(o_totalprice), lambda x: x > 100000)) AS INTEGER) AS big FROM orders GROUP BY o_custkey"
)
def e16b(spark, d):
    return Workspace(
        spark, {"orders": t(spark, d, "orders")}
    ).sql("SELECT o_custkey, sort_array(collect_set(o_orderpriority)) AS prios, size(filter(collect_list(o_totalprice), x -> x > 100000)) AS big FROM orders GROUP BY o_custkey")



