"""Scripts, limits and the read-only guard of the SQL workspace."""

from __future__ import annotations

import pytest

from tidewell.plans.sqlspace import Workspace, single, statements


@pytest.fixture
def space(spark):
    return Workspace(spark, {"t": spark.range(50).selectExpr("id", "id * 2 AS `limit`")})


def test_scripts_know_comments_and_quotes():
    assert statements("SELECT 1 AS a -- it's one; really\n; SELECT 2 AS b") == ["SELECT 1 AS a", "SELECT 2 AS b"]
    assert statements("/* a; /* b; */ c; */ SELECT ';' ; ; SELECT \"x;\" -- end") == ["SELECT ';'", 'SELECT "x;"']
    assert statements(r"SELECT 'it\'s; -- no'; SELECT `a;b`") == [r"SELECT 'it\'s; -- no'", "SELECT `a;b`"]
    assert statements(" ;; -- nothing\n /* open ; ") == []


def test_script_with_comments_runs(space):
    assert space.sql("SELECT 1 AS a -- it's one; really\n; SELECT 2 AS b").collect() == [(2,)]


@pytest.mark.parametrize("text, rows", [
    ("SELECT `limit` FROM t", 10), ("SELECT * FROM (SELECT * FROM t LIMIT 30)", 10), ("SELECT id FROM t LIMIT 20", 20), ("SELECT 'limit 5' AS x FROM t", 10),
    ("WITH x AS (SELECT * FROM t LIMIT 40) SELECT * FROM x", 10), ("WITH x AS (SELECT * FROM t) SELECT * FROM x ORDER BY id LIMIT 15 OFFSET 3", 15),
    ("SELECT id FROM t -- LIMIT 30", 10), ("SELECT id FROM t WHERE id IN (SELECT id FROM t LIMIT 30) LIMIT 12", 12), ("SELECT id FROM t LIMIT ALL", 10),
])
def test_only_a_limit_at_the_top_counts(space, text, rows):
    assert space.sql(text, limit=10).count() == rows


def test_single(spark):
    assert single(spark.range(30), "SELECT id AS limit FROM df", 7).count() == 7


@pytest.mark.parametrize("text", [
    "SELECT reflect('java.lang.System', 'setProperty', 'zz', '1')", "SELECT java_method('java.lang.System', 'setProperty', 'zz', '1') AS a FROM t",
    "SELECT try_reflect('java.lang.System', 'setProperty', 'zz', '1')", "WITH x AS (SELECT 1 AS id) INSERT INTO t SELECT * FROM x",
    "SELECT id FROM t WHERE id IN (SELECT length(reflect('java.lang.System', 'setProperty', 'zz', '1')) FROM t)", "SET a = b", "DROP VIEW t",
    "SELECT 1; CREATE TEMP VIEW v AS SELECT 1", "EXPLAIN SELECT 1", "CACHE TABLE t",
])
def test_guard_refuses_what_acts(spark, space, text):
    with pytest.raises(ValueError):
        space.sql(text, read_only=True)
    assert spark._jvm.java.lang.System.getProperty("zz") is None


@pytest.mark.parametrize("text", [
    "/* c */ SELECT id FROM t", "-- c\nSELECT id FROM t", "WITH x AS (SELECT * FROM t) SELECT id FROM x", "SELECT 'reflect(1)' AS id FROM t",
    "SELECT id FROM t EXCEPT SELECT id FROM t WHERE id < 0", "SELECT id FROM t UNION SELECT id FROM t",
])
def test_guard_lets_queries_pass(space, text):
    assert space.sql(text, read_only=True).count() > 0


def test_guard_refuses_python_table_functions(spark, space):
    from pyspark.sql.functions import udtf

    class Rows:
        def eval(self):
            yield (1,)

    spark.udtf.register("rows_of_python", udtf(Rows, returnType="a int"))
    with pytest.raises(ValueError):
        space.sql("SELECT * FROM rows_of_python()", read_only=True)
