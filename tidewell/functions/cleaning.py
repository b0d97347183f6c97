"""Null handling and coercion shared by the operators. Null is the only missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def name(column: str) -> Column:
    """A column by its literal name, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMERIC)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def number(c: Column) -> Column:
    """A number where the value can be read as one, else null."""
    return c.cast("string").try_cast("double")


def sanitize(df: DataFrame, timestamps_as_text: bool = False) -> DataFrame:
    """NaN and infinities become null, decimals become doubles; applied once, at ingest."""
    out = []
    for f in df.schema.fields:
        c = name(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif timestamps_as_text and isinstance(f.dataType, TEMPORAL):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def share(part: Column, whole: Column) -> Column:
    """Percentage, null over an empty whole."""
    return F.try_divide(F.lit(100.0) * part, whole)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the complete pairs; null where a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), spread))


#: Code points whose upper case in Java is several, and their single one (their own where there is none).
_EXPANDING = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1]
_SINGLE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _EXPANDING]


def upper(text: Column) -> Column:
    """Upper case by code point, as SQL engines do: ß is ẞ, not SS, and lengths stay."""
    known = "".join(_EXPANDING)
    parts = F.regexp_extract_all(text, F.lit(f"[{known}]+|[^{known}]+"), F.lit(0))
    each = F.transform(parts, lambda p: F.when(p.rlike(f"^[{known}]"), F.translate(p, known, "".join(_SINGLE))).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{known}]"), F.array_join(each, "")).otherwise(F.upper(text))
