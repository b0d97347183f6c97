"""Two-dataset joins, join graphs, as-of joins and remembered relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.cleaning import name

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def join_datasets(a: DataFrame, b: DataFrame, how: str, keys_a: list[str], keys_b: list[str]) -> DataFrame:
    """Join on one or more key pairs; null keys match null keys.

    A key of the same name on both sides is one column; keys of different names
    are both kept; other shared names get ``_a`` and ``_b``. Broadcast or
    sort-merge is left to the optimizer.
    """
    merged = [k for k, j in zip(keys_a, keys_b) if k == j]
    shared = (set(a.columns) & set(b.columns)) - set(merged)
    left = a.select(*(name(c).alias(f"a:{c}") for c in a.columns))
    right = b.select(*(name(c).alias(f"b:{c}") for c in b.columns))
    match = reduce(lambda x, y: x & y, (name(f"a:{k}").eqNullSafe(name(f"b:{j}")) for k, j in zip(keys_a, keys_b)))
    out = left.join(right, match, HOW[how])
    columns = [F.coalesce(name(f"a:{c}"), name(f"b:{c}")).alias(c) if c in merged else name(f"a:{c}").alias(f"{c}_a" if c in shared else c) for c in a.columns]
    columns += [name(f"b:{c}").alias(f"{c}_b" if c in shared else c) for c in b.columns if c not in merged]
    return out.select(*columns)


def edge_keys(edge: dict) -> list[tuple[str, str]]:
    """All key pairs of an edge, each once, in order."""
    pairs = [(edge["source_key"], edge["target_key"])] if edge.get("source_key") and edge.get("target_key") else []
    pairs += [(c["source_key"], c["target_key"]) for c in edge.get("conditions", [])]
    return list(dict.fromkeys(pairs))


def join_graph(tables: dict[str, DataFrame], edges: list[dict], start: str | None = None) -> DataFrame:
    """Left-deep join in edge order; ordinary SQL null rules.

    An edge without keys is a cross join. Repeated output names get ``_1``, ``_2``.
    """
    start = start or (edges[0]["source"] if edges else next(iter(tables)))
    owner: dict[tuple[str, str], str] = {}
    used: dict[str, int] = {}

    def renamed(node: str) -> DataFrame:
        new = []
        for c in tables[node].columns:
            k = used.get(c.lower(), 0)
            used[c.lower()] = k + 1
            owner[node, c] = f"{c}_{k}" if k else c
            new.append(name(c).alias(owner[node, c]))
        return tables[node].select(*new)

    out, seen = renamed(start), {start}
    for e in edges:
        node = e["target"] if e["source"] in seen else e["source"]
        if node in seen:
            raise ValueError(f"both ends of {e} are joined already")
        right = renamed(node)
        seen.add(node)
        how = {"LEFT": "left", "RIGHT": "right", "FULL": "full"}.get(str(e.get("join_type", "INNER")).upper(), "inner")
        pairs = edge_keys(e)
        if not pairs:
            out = out.crossJoin(right)
            continue
        on = reduce(lambda x, y: x & y, (name(owner[e["source"], s]) == name(owner[e["target"], t]) for s, t in pairs))
        out = out.join(right, on, how)
    return out


def join_sql(labels: dict[str, str], edges: list[dict], start: str | None = None) -> str:
    """The same graph as SQL text."""
    start = start or (edges[0]["source"] if edges else next(iter(labels)))
    quoted = {k: "`" + v.replace("`", "``") + "`" for k, v in labels.items()}
    text, seen = f"SELECT * FROM {quoted[start]}", {start}
    for e in edges:
        node = e["target"] if e["source"] in seen else e["source"]
        seen.add(node)
        how = {"LEFT": "LEFT", "RIGHT": "RIGHT", "FULL": "FULL"}.get(str(e.get("join_type", "INNER")).upper(), "INNER")
        on = " AND ".join(f"{quoted[e['source']]}.`{s}` = {quoted[e['target']]}.`{t}`" for s, t in edge_keys(e)) or "1 = 1"
        text += f"\n{how} JOIN {quoted[node]} ON {on}"
    return text


def limited(df: DataFrame, limit: int = 1000) -> tuple[DataFrame, bool]:
    """The first rows, and whether there were more."""
    return df.limit(limit), df.limit(limit + 1).count() > limit


def relationships(remembered: DataFrame, datasets: DataFrame) -> DataFrame:
    """Remembered pairs with names, newest first. remembered: a, b, description, created_at; datasets: id, name."""
    d = datasets.select("id", "name")
    out = remembered.join(
        d.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a", "left"
    ).join(d.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b", "left")
    return out.orderBy(F.col("created_at").desc(), "a", "b").select("name_a", "name_b", "description", "created_at")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str]) -> DataFrame:
    """For each left row the ``columns`` of the last right row at or before it.

    One shuffle by ``by``: both sides are unioned and the last right values carried
    along the order, instead of a range join.
    """
    width = [*by, on]
    r = right.select(
        *(name(c) for c in width), F.struct(*(name(c) for c in columns)).alias("__r"), F.lit(0).alias("__side"),
        *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in width)
    )
    side = left.select(
        *(name(c) for c in width), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__side"),
        *(name(c) for c in left.columns if c not in width)
    )
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(side).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select(*(name(c) for c in left.columns), *(F.col("__last")[c].alias(f"{c}_asof" if c in left.columns else c) for c in columns))
