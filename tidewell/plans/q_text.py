"""Queries of groups M (text), N (insights), O (rules) and P (history, collaboration)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.cleaning import upper
from tidewell.operators import history as H
from tidewell.operators import insights as N
from tidewell.operators import outliers as U
from tidewell.operators import profile as P
from tidewell.operators import rules as R
from tidewell.operators import text as M

from .fixtures import O, orders, t
from .q_profile import _M, _MIX, _mix, _profile_sql
from .registry import query


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: Conversations with nulls, blanks and shouting by a rule.
C = "c AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 2 THEN NULL WHEN conv_id % 17 = 3 THEN '  ' WHEN conv_id % 19 = 2 THEN upper(text) WHEN conv_id % 23 = 1 THEN '1,234.5' ELSE text END AS text FROM conversations)"
W = f"WITH {C} "


def convs(spark, d):
    return t(spark, d, "conversations").withColumn("caps", upper(F.col("text"))).selectExpr(
        "conv_id * 1000 + turn AS id",
        "CASE WHEN turn % 3 = 2 THEN NULL WHEN conv_id % 17 = 3 THEN '  ' WHEN conv_id % 19 = 2 THEN caps WHEN conv_id % 23 = 1 THEN '1,234.5' ELSE text END AS text"
    )


_FULL = "text IS NOT NULL AND trim(text) <> ''"


@query(
    "m01_text_counts",
    f"{W}SELECT count(*) AS rows, count(*) - count(text) AS missing, count(*) FILTER (WHERE text IS NOT NULL AND trim(text) = '') AS blank, count(text) - count(DISTINCT text) AS duplicates, round(100.0 * (count(*) - count(text)) / count(*), 4) AS missing_pct FROM c"
)
def m01(spark, d):
    return _r(M.overview(convs(spark, d), "text"), 4, "missing_pct").select("rows", "missing", "blank", "duplicates", "missing_pct")


@query(
    "m02_top_duplicates",
    "SELECT CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS value, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, text LIMIT 10"
)
def m02(spark, d):
    return M.top_duplicates(t(spark, d, "documents"), "text")


@query(
    "m03_length_stats",
    f"{W}SELECT round(avg(length(text)), 4) AS mean_length, quantile_cont(length(text), 0.5) AS median_length, CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length FROM c WHERE {_FULL}"
)
def m03(spark, d):
    return _r(M.overview(convs(spark, d), "text"), 4, "mean_length").select("mean_length", "median_length", "min_length", "max_length")


@query(
    "m04_length_outliers",
    f"{W}SELECT count(*) FILTER (WHERE length(text) <= 2) AS too_short, count(*) FILTER (WHERE length(text) > q3 + 1.5 * (q3 - q1)) AS too_long FROM c, (SELECT quantile_cont(length(text), 0.25) AS q1, quantile_cont(length(text), 0.75) AS q3 FROM c WHERE {_FULL}) WHERE {_FULL}"
)
def m04(spark, d):
    return M.length_outliers(convs(spark, d), "text")


@query(
    "m05_length_histogram",
    f"{W.rstrip()}, l AS (SELECT length(text)::DOUBLE AS x FROM c WHERE {_FULL}), s AS (SELECT min(x) AS lo, max(x) AS hi, CAST(least(greatest(count(DISTINCT x), 5), 20) AS INTEGER) AS k FROM l), h AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS bin, count(*) AS n FROM l, s GROUP BY 1), g AS (SELECT CAST(unnest(range(k)) AS INTEGER) AS bin, lo, hi, k FROM s) SELECT g.bin, round(lo + g.bin * (hi - lo) / k, 4) AS lo, round(lo + (g.bin + 1) * (hi - lo) / k, 4) AS hi, coalesce(n, 0) AS n FROM g LEFT JOIN h ON g.bin = h.bin"
)
def m05(spark, d):
    return _r(M.length_histogram(convs(spark, d), "text"), 4, "lo", "hi")


_STOP = ", ".join(f"'{w}'" for w in M.STOP_WORDS)
_TOK = "tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{2,}')) AS w FROM documents)"
_KEPT = f"kt AS (SELECT doc_id, list_filter(w, lambda x: x NOT IN ({_STOP})) AS w FROM tk)"


@query("m06_tokens", f"WITH {_TOK} SELECT doc_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first FROM tk")
def m06(spark, d):
    return t(spark, d, "documents").withColumn("w", M.tokens(F.col("text"))).select("doc_id", F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first"))


@query("m07_kept_tokens", f"WITH {_TOK}, {_KEPT} SELECT doc_id, CAST(len(w) AS INTEGER) AS n FROM kt")
def m07(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(M.kept_tokens(F.col("text"))).alias("n"))


@query(
    "m08_word_frequency",
    f"WITH {_TOK}, {_KEPT} SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM kt) GROUP BY 1 ORDER BY n DESC, word LIMIT 30"
)
def m08(spark, d):
    return M.top(M.word_counts(t(spark, d, "documents"), "text"), "word", 30)


for _n, _k in ((2, "m09_bigrams"), (3, "m09_trigrams")):
    _g = " || ' ' || ".join(f"w[i + {j}]" for j in range(_n))

    @query(
        _k,
        f"WITH {_TOK}, {_KEPT}, ix AS (SELECT w, unnest(range(1, len(w) - {_n - 2})) AS i FROM kt WHERE len(w) >= {_n}) SELECT {_g} AS ngram, count(*) AS n FROM ix GROUP BY 1 ORDER BY n DESC, ngram LIMIT 20"
    )
    def _ng(spark, d, n=_n):
        return M.top(M.ngrams(t(spark, d, "documents"), "text", n), "ngram", 20)


@query(
    "m10_vocabulary",
    f"WITH {_TOK} SELECT CAST(sum(len(w)) AS BIGINT) AS tokens, (SELECT count(DISTINCT word) FROM (SELECT unnest(w) AS word FROM tk)) AS vocabulary, round((SELECT count(DISTINCT word) FROM (SELECT unnest(w) AS word FROM tk)) / sum(len(w)), 6) AS type_token_ratio, round(avg(len(w)), 4) AS mean_words, quantile_cont(len(w), 0.5) AS median_words FROM tk"
)
def m10(spark, d):
    return _r(_r(M.vocabulary(t(spark, d, "documents"), "text"), 6, "type_token_ratio"), 4, "mean_words")


@query(
    "m11_caps_and_numbers",
    f"{W}SELECT count(*) FILTER (WHERE regexp_matches(text, '\\p{{L}}') AND upper(text) = text) AS all_caps, count(*) FILTER (WHERE regexp_full_match(regexp_replace(replace(trim(text), ',', ''), '^([^.]*)\\.', '\\1'), '\\d+')) AS numeric_only FROM c WHERE {_FULL}"
)
def m11(spark, d):
    return M.overview(convs(spark, d), "text").select("all_caps", "numeric_only")


@query(
    "m12_special_ratio",
    f"{W}SELECT round(avg(length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(text)), 6) AS special_ratio FROM c WHERE {_FULL}"
)
def m12(spark, d):
    return _r(M.overview(convs(spark, d), "text"), 6, "special_ratio").select("special_ratio")


@query(
    "m13_keywords",
    f"WITH {_TOK}, {_KEPT}, tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM kt) GROUP BY 1, 2), ch AS (SELECT word, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, word LIMIT 30), w AS (SELECT doc_id, word, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN ch USING (word)) SELECT word, round(sum(u) / (SELECT count(*) FROM documents), 6) AS score FROM (SELECT word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w) GROUP BY 1 ORDER BY sum(u) DESC, word LIMIT 20"
)
def m13(spark, d):
    return _r(M.keywords(t(spark, d, "documents"), "text", "doc_id"), 6, "score")


def _lex(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SENT = f"WITH tk AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text || CASE WHEN conv_id % 3 = 0 THEN ' great' WHEN conv_id % 3 = 1 THEN ' bad idea' ELSE '' END), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))) AS w FROM conversations), v AS (SELECT len(list_intersect(w, {_lex(M.POSITIVE)})) - len(list_intersect(w, {_lex(M.NEGATIVE)})) AS v FROM tk)"


@query(
    "m14_sentiment",
    f"{_SENT} SELECT count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v < 0) AS negative, count(*) FILTER (WHERE v = 0) AS neutral FROM v"
)
def m14(spark, d):
    return M.sentiment(t(spark, d, "conversations").withColumn(
        "text", F.expr("text || CASE WHEN conv_id % 3 = 0 THEN ' great' WHEN conv_id % 3 = 1 THEN ' bad idea' ELSE '' END")
    ), "text")


_VOTES = ", ".join(
    f"{{'hits': len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words)}))), 'language': '{k}'}}" for k, words in M.LANGUAGES.items()
)


@query(
    "m15_language_votes",
    f"WITH w AS (SELECT lang, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT lang, list_max([{_VOTES}]) AS b FROM w) SELECT lang, CASE WHEN b.hits > 0 THEN b.language ELSE 'unknown' END AS language, count(*) AS n FROM b GROUP BY 1, 2"
)
def m15(spark, d):
    docs = t(spark, d, "documents")
    return M.language_votes(docs, "text", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


_PII = [("email", M.EMAIL), ("url", "(?i)https?://[^\\s,]+|www\\.[^\\s,]+"), ("phone", M.PHONE)]
_PT = "x AS (SELECT text || CASE WHEN doc_id % 9 = 0 THEN ' see https://example.com/' || doc_id ELSE '' END AS text FROM documents)"


@query(
    "m16_personal_data",
    f"WITH {_PT}, f AS ({' UNION ALL '.join(f'''SELECT '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 0)) AS value FROM x''' for k, p in _PII)}) SELECT kind, count(*) AS matches, count(DISTINCT value) AS distinct_values, list_sort(list(DISTINCT value))[1:5] AS samples FROM f GROUP BY 1"
)
def m16(spark, d):
    df = t(spark, d, "documents").withColumn("text", F.expr("text || CASE WHEN doc_id % 9 = 0 THEN ' see https://example.com/' || doc_id ELSE '' END"))
    return M.personal_data(df, "text")


@query(
    "n09_from_text",
    f"{W}SELECT 'text' AS source, printf('%.1f%% missing', 100.0 * (count(*) - count(text)) / count(*)) AS message, 'warning' AS severity FROM c HAVING 100.0 * (count(*) - count(text)) / count(*) > 20 UNION ALL SELECT 'text', printf('%.1f%% duplicates', 100.0 * (count(text) - count(DISTINCT text)) / count(*)), 'warning' FROM c HAVING 100.0 * (count(text) - count(DISTINCT text)) / count(*) > 30"
)
def n09(spark, d):
    return N.from_text(M.overview(convs(spark, d), "text"))


@query(
    "m17_text_insights",
    f"{_SENT.replace('conv_id % 3 = 1 THEN', 'conv_id % 3 >= 1 THEN').replace(' bad idea', ' great').replace('v AS', 'v AS')}, t AS (SELECT text || ' great' AS text FROM conversations), o AS (SELECT 100.0 * (count(*) - count(text)) / count(*) AS gone, 100.0 * (count(text) - count(DISTINCT text)) / count(*) AS twice, avg(length(text)) AS mean FROM t) SELECT 'text' AS source, printf('%.1f%% positive', 100.0 * count(*) FILTER (WHERE v > 0) / count(*)) AS message, 'info' AS severity FROM v UNION ALL SELECT 'text', printf('%.1f%% missing', gone), 'warning' FROM o WHERE gone > 20 UNION ALL SELECT 'text', printf('%.1f%% duplicates', twice), 'warning' FROM o WHERE twice > 30 UNION ALL SELECT 'text', printf('short texts, %.1f characters', mean), 'info' FROM o WHERE mean < 10 UNION ALL SELECT 'text', printf('long texts, %.1f characters', mean), 'info' FROM o WHERE mean > 5000"
)
def m17(spark, d):
    df = t(spark, d, "conversations").withColumn("text", F.expr("text || ' great'"))
    return N.from_text(M.overview(df, "text"), mood=M.sentiment(df, "text"))


@query(
    "n01_from_profile",
    f"{_M.rstrip()}, p AS ({_profile_sql('m', _MIX)}) SELECT 'profile' AS source, column_name || ' is constant' AS message, 'warning' AS severity FROM p WHERE semantic_type = 'constant' UNION ALL SELECT 'profile', column_name || ' looks like an identifier', 'info' FROM p WHERE semantic_type = 'id_like' UNION ALL SELECT 'profile', printf('%s: %.1f%% missing', column_name, missing_pct), 'warning' FROM p WHERE missing_pct > 20 AND missing_pct <= 50"
)
def n01(spark, d):
    return N.from_profile(P.column_profile(_mix(spark, d)))


@query("n02_from_distribution")
def n02(spark, d):
    from tidewell.operators.tests_stat import shapiro

    orders = t(spark, d, "orders")
    row = shapiro(orders, "o_totalprice").select(F.lit("o_totalprice").alias("column_name"), "p")
    return N.from_distribution(row.crossJoin(orders.agg(F.skewness("o_totalprice").alias("skewness"))))


@query(
    "n03_from_correlations",
    "SELECT 'correlations' AS source, printf('a and b: r = %.2f', corr(a, b)) AS message, 'critical' AS severity FROM (SELECT l_quantity AS a, l_quantity + l_tax AS b FROM lineitem)"
)
def n03(spark, d):
    from tidewell.operators.assoc import pearson

    return N.from_correlations(pearson(t(spark, d, "lineitem").selectExpr("l_quantity AS a", "l_quantity + l_tax AS b", "l_discount AS c")))


@query(
    "n04_from_outliers",
    "SELECT 'outliers' AS source, printf('x: %.1f%% outliers', 100.0 * count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(*)) AS message, 'warning' AS severity FROM (SELECT CASE WHEN l_orderkey % 20 = 0 THEN l_quantity * 20 ELSE l_quantity END AS x FROM lineitem), (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT CASE WHEN l_orderkey % 20 = 0 THEN l_quantity * 20 ELSE l_quantity END AS x FROM lineitem))"
)
def n04(spark, d):
    return N.from_outliers(U.fences(t(spark, d, "lineitem").selectExpr("CASE WHEN l_orderkey % 20 = 0 THEN l_quantity * 20 ELSE l_quantity END AS x"), ["x"]))


@query("n05_from_quality", "SELECT 'quality' AS source, 'quality 100: good' AS message, 'info' AS severity")
def n05(spark, d):
    return N.from_quality(P.quality_score(t(spark, d, "customer")))


@query("n06_from_timeseries")
def n06(spark, d):
    from tidewell.operators import series as S

    from .q_series import K, series

    s = series(spark, d)
    return N.from_timeseries(S.stationarity(s, K), S.anomalies(s, K, 20), "k")


@query(
    "n07_from_missing",
    "SELECT 'missing' AS source, printf('%.1f%% of cells missing', 100.0 * (count(*) - count(a) + count(*) - count(b)) / (3 * count(*))) AS message, 'critical' AS severity FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1 END AS a, CASE WHEN o_orderkey % 8 <> 0 THEN NULL ELSE 1 END AS b FROM orders) UNION ALL SELECT 'missing', printf('a: %.1f%% missing', 100.0 * count(*) FILTER (WHERE o_orderkey % 2 = 0) / count(*)), 'warning' FROM orders UNION ALL SELECT 'missing', printf('b: %.1f%% missing', 100.0 * count(*) FILTER (WHERE o_orderkey % 8 <> 0) / count(*)), 'critical' FROM orders"
)
def n07(spark, d):
    df = t(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1 END AS a", "CASE WHEN o_orderkey % 8 <> 0 THEN NULL ELSE 1 END AS b"
    )
    return N.from_missing(P.missing_total(df), P.missing_table(df))


@query("n08_from_importance")
def n08(spark, d):
    from tidewell.operators import importance as I

    df = t(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", "o_totalprice + 1 AS copy")
    a = I.associations(df, "o_totalprice")
    return N.from_importance(
        a.select("feature", F.col("strength").alias("importance"), F.lit(0.0).alias("mi")), I.problem_type(df, "o_totalprice"), I.leakage(a)
    )


RULES = [
    {"column_name": "price", "rule_type": "not_null"}, {
        "column_name": "price", "rule_type": "range", "params": {"min": 20000, "max": 250000}
    }, {"column_name": "prio", "rule_type": "regex", "params": {"pattern": "[1-3]-"}},
    {"column_name": "o_custkey", "rule_type": "unique"}, {
        "column_name": "prio", "rule_type": "allowed_values", "params": {"values": ["1-URGENT", "2-HIGH", "5-LOW"]}
    },
]
_RS = "r AS (SELECT 0 AS rule_id, 'price' AS column_name, 'not_null' AS rule_type, count(*) FILTER (WHERE price IS NULL) AS fail_count, count(*) AS t FROM o UNION ALL SELECT 1, 'price', 'range', count(*) FILTER (WHERE price < 20000 OR price > 250000), count(*) FROM o UNION ALL SELECT 2, 'prio', 'regex', count(*) FILTER (WHERE NOT coalesce(regexp_matches(prio, '^[1-3]-'), false)), count(*) FROM o UNION ALL SELECT 3, 'o_custkey', 'unique', (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM o GROUP BY o_custkey) WHERE n > 1), count(*) FROM o UNION ALL SELECT 4, 'prio', 'allowed_values', count(*) FILTER (WHERE prio IS NOT NULL AND prio NOT IN ('1-URGENT', '2-HIGH', '5-LOW')), count(*) FROM o)"
for _i, _k in enumerate(("o01_not_null", "o02_range", "o03_regex", "o04_unique", "o05_allowed_values")):

    @query(_k, f"{O.rstrip()}, {_RS} SELECT rule_type, fail_count FROM r WHERE rule_id = {_i}")
    def _rule(spark, d, i=_i):
        return R.check(orders(spark, d), [RULES[i]]).select("rule_type", "fail_count")


@query(
    "o06_rule_results",
    f"{O.rstrip()}, {_RS} SELECT rule_id, column_name, rule_type, fail_count, round(100.0 * fail_count / t, 4) AS fail_pct, round(100 - 100.0 * fail_count / t, 4) AS pass_pct FROM r"
)
def o06(spark, d):
    return _r(R.check(orders(spark, d), RULES), 4, "fail_pct", "pass_pct")


@query("o06_pass_rate", f"{O.rstrip()}, {_RS} SELECT round(avg(100 - 100.0 * fail_count / t) / 100, 6) AS overall_pass_rate FROM r")
def o06b(spark, d):
    return _r(R.pass_rate(R.check(orders(spark, d), RULES)), 6, "overall_pass_rate")


@query("o07_rule_table", f"{O.rstrip()}, {_RS} SELECT rule_id, fail_count FROM r")
def o07(spark, d):
    return R.check(orders(spark, d), R.load_rules(R.rule_table(spark, RULES))).select("rule_id", "fail_count")


RUNS = "runs AS (SELECT o_custkey % 10 AS dataset_id, o_orderdate AS run_at, o_orderkey AS row_count, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INTEGER) END AS quality_score, o_totalprice / 10000 AS missing_pct FROM orders)"


def runs(spark, d):
    return t(spark, d, "orders").selectExpr(
        "o_custkey % 10 AS dataset_id", "o_orderdate AS run_at", "o_orderkey AS row_count",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INTEGER) END AS quality_score", "o_totalprice / 10000 AS missing_pct"
    )


@query("p01_record_run", "SELECT CAST(5 AS BIGINT) AS dataset_id, count(*) AS row_count, CAST(9 AS INTEGER) AS col_count, CAST(0 AS DOUBLE) AS missing_pct, 'user' AS triggered_by FROM orders".replace(
    "9 AS INTEGER", "(SELECT count(*) FROM (DESCRIBE orders)) AS INTEGER"
))
def p01(spark, d):
    from .q_sources import _scratch

    return H.record_run(t(spark, d, "orders"), 5, _scratch(spark, "runs")).select("dataset_id", "row_count", "col_count", "missing_pct", "triggered_by")


@query("p02_history", f"WITH {RUNS} SELECT dataset_id, row_count, quality_score FROM runs WHERE dataset_id = 3 ORDER BY run_at DESC, row_count DESC LIMIT 50")
def p02(spark, d):
    return H.newest(runs(spark, d), 3).select("dataset_id", "row_count", "quality_score")


_LAST = f"WITH {RUNS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY run_at DESC, row_count DESC) AS r FROM runs) WHERE r = 1)"


@query("p03_latest", f"{_LAST} SELECT dataset_id, row_count, quality_score FROM last")
def p03(spark, d):
    return H.latest(runs(spark, d)).select("dataset_id", "row_count", "quality_score")


@query(
    "p04_trend",
    f"WITH {RUNS} SELECT dataset_id, row_count, quality_score, quality_score - lag(quality_score) OVER (PARTITION BY dataset_id ORDER BY run_at, row_count) AS change FROM runs"
)
def p04(spark, d):
    return H.trend(runs(spark, d)).select("dataset_id", "row_count", "quality_score", "change")


@query(
    "p05_worst",
    f"{_LAST} SELECT (SELECT dataset_id FROM last ORDER BY coalesce(quality_score, 100), dataset_id LIMIT 1) AS worst_quality, (SELECT dataset_id FROM last ORDER BY coalesce(missing_pct, 0) DESC, dataset_id LIMIT 1) AS most_missing"
)
def p05(spark, d):
    return H.worst(H.latest(runs(spark, d)))


@query(
    "p06_enrich",
    "SELECT c.conv_id AS id, coalesce(n, 0) AS comments, coalesce(v, 0) AS votes, coalesce(own, false) AS own FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'assistant' GROUP BY 1) x ON c.conv_id = x.conv_id LEFT JOIN (SELECT event_id % 200 AS id, count(*) AS v, bool_or(user_id = 7) AS own FROM events GROUP BY 1) e ON e.id = c.conv_id"
)
def p06(spark, d):
    c = t(spark, d, "conversations")
    votes = t(spark, d, "events").selectExpr("event_id % 200 AS parent_id", "user_id")
    return H.enrich(c.select(F.col("conv_id").alias("id")).distinct(), c.selectExpr("conv_id AS parent_id", "role = 'assistant' AS is_system"), votes, 7)


@query(
    "p07_reactions",
    "SELECT c.conv_id * 1000 + turn AS id, n_name AS name, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes FROM conversations c JOIN nation ON n_nationkey = c.conv_id % 30 LEFT JOIN (SELECT event_id % 3000 AS id, count(*) FILTER (WHERE event_type = 'click') AS likes, count(*) FILTER (WHERE event_type = 'error') AS dislikes FROM events GROUP BY 1) v ON v.id = c.conv_id * 1000 + turn"
)
def p07(spark, d):
    c = t(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "conv_id % 30 AS author_id", "turn AS at")
    v = t(spark, d, "events").selectExpr("event_id % 3000 AS id", "CASE event_type WHEN 'click' THEN 'like' WHEN 'error' THEN 'dislike' END AS kind")
    return H.reactions(c, v, t(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name")).select("id", "name", "likes", "dislikes")


@query(
    "p08_mentions",
    "SELECT page_id, list_sort(list_distinct(regexp_extract_all('<p>@Ann Lee and @Bob &amp; @Ann Lee; see @page' || page_id || '</p>', '@(\\p{Lu}[\\p{L}\\p{N}_.-]*(?: \\p{Lu}[\\p{L}\\p{N}_.-]*){0,2})', 1))) AS names FROM pages"
)
def p08(spark, d):
    return t(spark, d, "pages").select("page_id", F.sort_array(H.mentions(F.concat(
        F.lit("<p>@Ann Lee and @Bob &amp; @Ann Lee; see @page"), F.col("page_id").cast("string"), F.lit("</p>")
    ))).alias("names"))


@query(
    "p09_preview_text",
    "SELECT page_id, substring(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 160) AS preview FROM pages"
)
def p09(spark, d):
    return t(spark, d, "pages").select("page_id", H.preview_text(F.col("html")).alias("preview"))


@query(
    "p10_articles",
    "SELECT c_custkey AS id, coalesce(n, 0) AS attachments, coalesce(names, []) AS datasets FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, list_sort(list(DISTINCT n_name)) AS names FROM orders JOIN nation ON n_nationkey = o_orderkey % 40 GROUP BY 1) l ON l.o_custkey = c_custkey"
)
def p10(spark, d):
    o = t(spark, d, "orders")
    return H.articles(
        t(spark, d, "customer").selectExpr("c_custkey AS id"), o.selectExpr("o_custkey AS article_id"),
        o.selectExpr("o_custkey AS article_id", "o_orderkey % 40 AS dataset_id"),
        t(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    )


@query(
    "p11_delete_children_first",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)"
)
def p11(spark, d):
    tables = [
        ("customer", t(spark, d, "customer"), "c_custkey", None), ("orders", t(spark, d, "orders"), "o_orderkey", "o_custkey"),
        ("lineitem", t(spark, d, "lineitem"), "l_orderkey", "l_orderkey")
    ]
    return H.delete_children_first(
        tables, t(spark, d, "customer").filter("c_nationkey = 3").selectExpr("c_custkey AS key")
    )["lineitem"].select("l_orderkey", "l_linenumber")
