"""Datasets in and out: one reader for all formats, JDBC, listings, imports, sinks, catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.cleaning import name, sanitize
from tidewell.plans.sqlspace import slug

#: Source type -> reader format and default options.
SOURCES: dict[str, tuple[str, dict[str, str]]] = {
    "csv": ("csv", {"header": "true", "inferSchema": "true"}),
    "tsv": ("csv", {"header": "true", "inferSchema": "true", "sep": "\t"}),
    "txt": ("csv", {"header": "true", "inferSchema": "true", "sep": "\t"}),
    "json": ("json", {"multiLine": "true"}),
    "jsonl": ("json", {}),
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
    "postgresql": ("jdbc", {"driver": "org.postgresql.Driver"}),
    "mysql": ("jdbc", {"driver": "com.mysql.cj.jdbc.Driver"}),
    "mssql": ("jdbc", {"driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver"}),
    "sqlite": ("jdbc", {"driver": "org.sqlite.JDBC"}),
    "derby": ("jdbc", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}),
}
DELIMITERS = ",;\t|"
SCHEMES = {"s3": "s3a", "azure": "abfss", "gcs": "gs", "file": "file"}


def sniff_delimiter(spark: SparkSession, uri: str, lines: int = 50) -> str:
    """The separator that occurs most in the first lines; a comma when none does."""
    head = [r[0] for r in spark.read.text(uri).limit(lines).collect()]
    found = {s: sum(line.count(s) for line in head) for s in DELIMITERS}
    best = max(found, key=lambda s: found[s])
    return best if found[best] else ","


def flatten(df: DataFrame) -> DataFrame:
    """Nested records become dotted columns; lists stay as they are."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                c = F.col("`" + here[0] + "`")
                for p in here[1:]:
                    c = c.getField(p)
                out.append(c.alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def extension(uri: str) -> str:
    found = re.search(r"\.([a-z0-9]+)/?$", uri.lower())
    return found[1] if found else ""


def read_dataset(spark: SparkSession, uri: str, kind: str | None = None, **options: str) -> DataFrame:
    """Read by extension or by ``kind``; unknown extensions are read as delimited text."""
    kind = kind or extension(uri)
    fmt, defaults = SOURCES.get(kind, SOURCES["csv"])
    settings = defaults | options
    if fmt == "csv" and "sep" not in settings:
        settings["sep"] = sniff_delimiter(spark, uri)
    out = spark.read.format(fmt).options(**settings).load(uri)
    return flatten(out) if fmt == "json" else out


def object_uri(provider: str, bucket: str, key: str) -> str:
    """URI of an object; credentials belong into the Hadoop configuration."""
    if provider not in SCHEMES:
        raise ValueError(f"unknown provider {provider!r}")
    return f"{SCHEMES[provider]}://{bucket}/{key.lstrip('/')}"


def read_jdbc(
    spark: SparkSession, url: str, table: str | None = None, query: str | None = None, limit: int | None = None,
    partition: tuple[str, int, int, int] | None = None, **options: str
) -> DataFrame:
    """A table or a query of a database; ``partition`` is (column, lower, upper, parts) for parallel reads.

    All rows come unless ``limit`` is given.
    """
    r = spark.read.format("jdbc").option("url", url).options(**options)
    if query is not None:
        r = r.option("query", query.rstrip(" ;"))
    else:
        r = r.option("dbtable", table)
        if partition:
            column, lower, upper, parts = partition
            r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    out = r.load()
    return out if limit is None else out.limit(limit)


CATALOG_QUERIES = {
    "postgresql": "SELECT table_schema, table_name FROM information_schema.tables WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
    "mysql": "SELECT table_schema, table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "mssql": "SELECT table_schema, table_name FROM information_schema.tables",
    "sqlite": "SELECT '' AS table_schema, name AS table_name FROM sqlite_master WHERE type = 'table'",
    "derby": "SELECT s.schemaname AS table_schema, t.tablename AS table_name FROM sys.systables t JOIN sys.sysschemas s ON t.schemaid = s.schemaid WHERE t.tabletype = 'T'",
}


def list_tables(spark: SparkSession, kind: str, url: str, limit: int | None = None, **options: str) -> DataFrame:
    return read_jdbc(spark, url, query=CATALOG_QUERIES[kind], limit=limit, **options)


def list_objects(spark: SparkSession, uri: str, limit: int | None = None) -> DataFrame:
    """Rows (path, length) below a folder, by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select("path", "length").orderBy("path")
    return found if limit is None else found.limit(limit)


def head(df: DataFrame, n: int = 100) -> DataFrame:
    """The first rows as text, nulls as empty text."""
    return df.limit(n).select(*(F.coalesce(name(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def import_dataset(df: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Sanitise, cap if asked for, write as Parquet, and read back."""
    rows = sanitize(df if limit is None else df.limit(limit))
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write in the stored format; CSV with a header otherwise."""
    w = df.write.mode("errorifexists")
    if fmt in ("parquet", "orc", "json"):
        w.format(fmt).save(path)
    else:
        w.option("header", True).csv(path)


def save_as(df: DataFrame, path: str) -> DataFrame:
    """Save a result as a new dataset; an existing one is not overwritten."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def copy_dataset(spark: SparkSession, source: str, target: str) -> DataFrame:
    return save_as(spark.read.parquet(source), target)


def describe_with_examples(df: DataFrame) -> DataFrame:
    """:func:`describe` and, from one pass over the table, the filled rows and the smallest value of each column as text."""
    found = [F.struct(F.lit(c).alias("column_name"), F.count(name(c)).alias("filled"), F.min(name(c).cast("string")).alias("example")) for c in df.columns]
    one = df.agg(F.array(*found).alias("found")).select(F.inline("found"))
    return describe(df).join(F.broadcast(one), "column_name")


def describe(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, type string, nullable boolean")


def metadata(df: DataFrame) -> DataFrame:
    """One row: row_count, column_count, schema as JSON."""
    kinds = "{" + ", ".join(f'"{f.name}": "{f.dataType.simpleString()}"' for f in df.schema.fields) + "}"
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(kinds).alias("schema_info"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint) that doesn't depend on row order; repeated rows count."""
    h = F.xxhash64(*(F.coalesce(name(c).cast("string"), F.lit("\0")) for c in df.columns))
    # a sum of longs would overflow at some millions of rows
    s = F.sum(F.pmod(h, F.lit(1 << 40)).cast("decimal(20,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("x"), s.alias("s")
    ).select("rows", F.md5(F.concat_ws(":", "rows", "x", "s")).alias("fingerprint"))


def slugs(df: DataFrame, column: str, source: str | None = None) -> DataFrame:
    """Add ``slug``; tables of a source get its slug and two underscores in front."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name(column)), "[^a-z0-9]+", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).when(s == "", "t").otherwise(s)
    return df.withColumn("slug", F.concat(F.lit(f"{slug(source)}__"), s) if source else s)
