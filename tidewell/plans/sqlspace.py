"""SQL over a workspace of named datasets. Catalyst plans; this binds names, limits and guards."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def slug(text: str) -> str:
    """Lower case, other characters to single underscores, ``t_`` before a digit."""
    out = re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", text.lower())).strip("_")
    return f"t_{out}" if out[:1].isdigit() else out or "t"


class Workspace:
    """Datasets by slug. Views are lazy: tables that no statement names cost nothing."""

    def __init__(self, spark: SparkSession, datasets: dict[str, DataFrame]) -> None:
        self.spark, self.datasets = spark, {slug(k): v for k, v in datasets.items()}

    def register(self) -> Workspace:
        for k, df in self.datasets.items():
            df.createOrReplaceTempView(k)
        return self

    def sql(self, text: str, limit: int | None = None, read_only: bool = False) -> DataFrame:
        """Run a script; statements end at semicolons, the last one with rows is the answer."""
        self.register()
        out, last = None, ""
        for statement in statements(text):
            if read_only and not (is_read_only(statement) and only_reads(self.spark, statement)):
                raise ValueError("only SELECT statements are allowed")
            done = self.spark.sql(statement)
            if read_only and acts(done):
                raise ValueError("functions that run other code are not allowed")
            if done.columns:
                out, last = done, statement
        if out is None:
            raise ValueError("no statement returns rows")
        return out if limit is None or has_limit(self.spark, last) else out.limit(limit)

    def explain(self, text: str) -> str:
        self.register()
        return self.spark.sql(f"EXPLAIN FORMATTED {text.rstrip(' ;')}").first()[0]

    def describe(self) -> DataFrame:
        """Rows (dataset, column, type, position) of all datasets."""
        rows = [(k, f.name, f.dataType.simpleString(), i) for k, df in self.datasets.items() for i, f in enumerate(df.schema.fields)]
        return self.spark.createDataFrame(rows, "dataset string, column string, type string, position int")

    def search_columns(self, part: str, limit: int = 30) -> DataFrame:
        from pyspark.sql import functions as F

        return self.describe().filter(F.lower("column").contains(part.lower())).orderBy("dataset", "position").limit(limit)


def pieces(text: str) -> list[tuple[str, str]]:
    """The text as (kind, piece): ``code``, ``quoted`` (with its quotes) or ``comment``."""
    token = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*", re.S)
    found, at = [], 0
    while m := token.search(text, at):
        found.append(("code", text[at : m.start()]))
        end = m.end()
        if m[0] == "/*":  # these nest
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth, end = depth + (1 if n[0] == "/*" else -1), n.end()
            end = len(text) if depth else end
        found.append(("comment" if m[0][:2] in ("--", "/*") else "quoted", text[m.start() : end]))
        at = end
    return [x for x in [*found, ("code", text[at:])] if x[1]]


def statements(text: str) -> list[str]:
    """Statements of a script without their comments; semicolons in quotes or comments don't end one."""
    found = [""]
    for kind, piece in pieces(text):
        if kind == "comment":
            found[-1] += " "
        elif kind == "quoted":
            found[-1] += piece
        else:
            first, *rest = piece.split(";")
            found[-1] += first
            found += rest
    return [s.strip() for s in found if s.strip()]


def is_read_only(statement: str) -> bool:
    return re.match(r"\s*(select|with)\b", statement, re.I) is not None


def _parsed(spark: SparkSession, statement: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)


def _classes(plan) -> set[str]:
    """Names of all nodes and expressions of a plan, those of subqueries and views among them."""
    return {c.rsplit(".", 1)[-1] for c in re.findall(r'"class":"([\w.$]+)"', plan.toJSON())}


def only_reads(spark: SparkSession, statement: str) -> bool:
    """Whether Spark parses the statement as a plain query: no command and no insert, also not behind a WITH. Nothing is run."""
    acting = re.compile(r"Command$|Statement$|^(Insert|Create|Replace|Update|Delete|Merge|Drop|Alter|Truncate|Load|Overwrite|Append|Write|Set|Add)")
    return not any(acting.search(c) and c != "SetOperation" for c in _classes(_parsed(spark, statement)))


def acts(df: DataFrame) -> bool:
    """Whether the analysed query calls methods by reflection or Python table functions; analysis runs neither."""
    found = _classes(df._jdf.queryExecution().analyzed())
    return bool(found & {"CallMethodViaReflection", "TryReflect", "PythonUDTF", "UnresolvedPolymorphicPythonUDTF"})


def has_limit(spark: SparkSession, statement: str) -> bool:
    """Whether the query itself ends in LIMIT; a column of that name or a subquery's limit does not count."""
    plan = _parsed(spark, statement)
    while plan.nodeName() in ("UnresolvedWith", "PipeOperator"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "GlobalLimit"


def single(df: DataFrame, text: str, limit: int = 1000) -> DataFrame:
    """SQL over one dataset, named ``df``; a SELECT without LIMIT gets one."""
    return Workspace(df.sparkSession, {"df": df}).sql(text, limit)
