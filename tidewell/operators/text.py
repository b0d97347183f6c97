"""Text columns: counts, lengths, words, n-grams, keywords, sentiment, language vote, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import name, share, upper
from tidewell.operators.charts import histogram

#: The English stop words that word counts leave out.
STOP_WORDS = (
    "a an the and or but in on at to for of with by is it this that was are be been have has had do does did will would could should may might shall can need "
    "i you he she we they me him her us them my your his our their its what which who not no as from up out if then than so also just about into through during more very some any"
).split()
#: The lexicon of the sentiment vote.
POSITIVE = "good great excellent positive best amazing wonderful love nice perfect".split()
NEGATIVE = "bad poor terrible negative worst awful hate horrible wrong fail".split()
#: Patterns of personal data.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL = r"(?i)https?://[^\s,]+|www\.[^\s,]+"
PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
#: Frequent short words of each language; the vote goes to the list with most hits.
LANGUAGES = {
    "en": "the of and to in is that for it was with as on be at by this from are".split(),
    "de": "der die und das von zu mit ist den des dem nicht ein eine auf sich auch für".split(),
    "fr": "le la les de des et est un une du que qui dans pour par sur avec au".split(),
    "es": "el la los las de que y en un una es por con para se del como su".split(),
}


def _column(df: DataFrame, column: str) -> DataFrame:
    return df.select(name(column).cast("string").alias("text"))


def overview(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, missing, blank, duplicates, all_caps, numeric_only, lengths, special-character share."""
    t = F.col("text")
    full = t.isNotNull() & (F.trim(t) != "")
    n = F.length(t)
    letters = t.rlike(r"\p{L}")
    digits = F.regexp_replace(F.regexp_replace(F.trim(t), ",", ""), r"^([^.]*)\.", "$1")
    special = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", "")) / F.when(n > 0, n)
    rows = _column(df, column)
    a = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(t.isNull()).alias("missing"), F.count_if(t.isNotNull() & ~full).alias("blank"),
        F.count_if(full & letters & (upper(t) == t)).alias("all_caps"), F.count_if(full & digits.rlike(r"^\d+$")).alias("numeric_only"),
        F.avg(F.when(full, n)).alias("mean_length"), F.percentile(F.when(full, n), F.lit(0.5)).alias("median_length"), F.min(F.when(full, n)).alias("min_length"), F.max(F.when(full, n)).alias("max_length"),
        F.avg(F.when(full, special)).alias("special_ratio"),
    )
    d = rows.filter(t.isNotNull()).groupBy(
        F.xxhash64("text").alias("h"), F.sha1("text").alias("s")
    ).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return a.crossJoin(F.broadcast(d)).withColumns({f"{k}_pct": share(F.col(k), F.col("rows")) for k in ("missing", "blank", "duplicates")})


def top_duplicates(df: DataFrame, column: str, k: int = 10, width: int = 200) -> DataFrame:
    """Rows (value, n) of values found more than once, cut for display only."""
    g = _column(df, column).filter("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = g.orderBy(F.col("n").desc(), "text").limit(k)
    return top.select(F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("…"))).otherwise(F.col("text")).alias("value"), "n")


def length_outliers(df: DataFrame, column: str) -> DataFrame:
    """One row (too_short, too_long): at most two characters; beyond the upper fence."""
    n = _column(df, column).filter("text IS NOT NULL AND trim(text) <> ''").select(F.length("text").cast("double").alias("n"))
    q = n.agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return n.crossJoin(F.broadcast(q)).agg(
        F.count_if(F.col("n") <= 2).alias("too_short"),
        F.count_if(F.col("n") > F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("too_long")
    )


def length_histogram(df: DataFrame, column: str, unit: str = "chars") -> DataFrame:
    """Histogram of lengths, 5 to 20 bins by the number of distinct lengths."""
    t = _column(df, column).filter("text IS NOT NULL AND trim(text) <> ''")
    n = t.select((F.length("text") if unit == "chars" else F.size(F.split(F.trim("text"), r"\s+"))).alias("n"))
    k = n.agg(F.least(F.greatest(F.count_distinct("n"), F.lit(5)), F.lit(20)).alias("k")).first()["k"]
    return histogram(n, "n", bins=int(k))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more of a-z, whole words only."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{2,}(?![\p{L}\p{N}_])"), F.lit(0))


def kept_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda w: ~w.isin(*STOP_WORDS))


def word_counts(df: DataFrame, column: str, stop_words: bool = True) -> DataFrame:
    """Rows (word, n); stop words are left out unless asked for."""
    words = F.explode(kept_tokens(F.col("text")) if stop_words else tokens(F.col("text")))
    return _column(df, column).filter("text IS NOT NULL").select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.orderBy(F.col("n").desc(), key).limit(k)


def ngrams(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows (ngram, n) over the kept tokens of each text."""
    w = _column(df, column).filter("text IS NOT NULL").select(kept_tokens(F.col("text")).alias("w")).filter(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return w.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """One row: tokens, vocabulary, type_token_ratio, mean and median words per text."""
    c = word_counts(df, column, stop_words=False).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("vocabulary"))
    per = _column(df, column).filter("text IS NOT NULL").select(F.size(tokens(F.col("text"))).alias("s")).agg(
        F.avg("s").alias("mean_words"), F.percentile("s", F.lit(0.5)).alias("median_words")
    )
    return c.withColumn("type_token_ratio", F.try_divide(F.col("vocabulary"), F.col("tokens"))).crossJoin(F.broadcast(per))


def keywords(df: DataFrame, column: str, key: str, terms: int = 30, k: int = 20) -> DataFrame:
    """Rows (word, score): mean TF-IDF over all texts of the most frequent terms, rows of length one."""
    rows = df.select(name(key).alias("key"), name(column).cast("string").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    # the terms are chosen by one count of words; only their occurrences are grouped by text
    most = word_counts(df, column).orderBy(F.col("n").desc(), "word").limit(terms).select("word")
    found = rows.select("key", F.explode(kept_tokens(F.col("text"))).alias("word")).join(F.broadcast(most), "word")
    tf = found.groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf"))
    chosen = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = chosen.crossJoin(F.broadcast(total)).select("word", "total", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(F.broadcast(idf), "word").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return w.withColumn("u", F.col("w") / norm).groupBy("word").agg((F.sum("u") / F.first("total")).alias("score")).orderBy(F.col("score").desc(), "word").limit(k)


def sentiment(df: DataFrame, column: str) -> DataFrame:
    """One row (positive, negative, neutral): votes of a small lexicon, a text at a time."""
    s = F.array_distinct(tokens(F.col("text")))
    hits = lambda words: F.size(F.array_intersect(s, F.array(*map(F.lit, words))))
    d = _column(df, column).filter("text IS NOT NULL").select((hits(POSITIVE) - hits(NEGATIVE)).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("positive"), F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") == 0).alias("neutral"))


def language_votes(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows (key, language) by frequent words; ``unknown`` without any hit."""
    w = F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}_]+")
    rows = df.select(name(key).alias("key"), name(column).cast("string").alias("text")).filter("text IS NOT NULL").withColumn("w", w)

    def hits(words: list[str]) -> Column:
        return F.size(F.filter("w", lambda x: x.isin(*words)))

    votes = F.array(*(F.struct(hits(v).alias("hits"), F.lit(k).alias("language")) for k, v in LANGUAGES.items()))
    best = F.array_max(votes)
    return rows.select(F.col("key").alias(key), F.when(best["hits"] > 0, best["language"]).otherwise("unknown").alias("language"))


def personal_data(df: DataFrame, column: str, samples: int = 5) -> DataFrame:
    """Rows (kind, matches, distinct_values, samples) of e-mail addresses, URLs and phone numbers."""
    found = F.array(*(
        F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), 0).alias("v")) for k,
        p in (("email", EMAIL), ("url", URL), ("phone", PHONE))
    ))
    long = _column(df, column).filter("text IS NOT NULL").select(F.explode(found).alias("x")).select("x.kind", F.explode("x.v").alias("value"))
    counts = long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn(
        "r", F.row_number().over(Window.partitionBy("kind").orderBy("value"))
    ).filter(F.col("r") <= samples).groupBy("kind").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    g = counts.groupBy("kind").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("distinct_values"))
    return g.join(F.broadcast(first), "kind")
