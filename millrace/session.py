"""A session of the warehouse: SQL text in, DataFrames out."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from millrace import dialect
from millrace.catalog import Catalog
from millrace.functions.registry import FunctionRegistry, builtins


def spark_session(name: str = "millrace", master: str | None = None, **conf) -> SparkSession:
    """A Spark session with adaptive execution and UTC. Sizes of partitions are left to the
    cluster's settings and AQE."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Functions that SQL text calls by Spark's own names.
BUILT_IN = {"sum", "max", "min", "avg", "count", "random"}


def typer(spark: SparkSession) -> dialect.Typer:
    """The types of a SELECT's columns, by analysis alone; None where it can't be analysed."""

    def types(text: str) -> list[str] | None:
        try:
            return [f.dataType.simpleString() for f in spark.sql(text).schema]
        except (AnalysisException, ParseException):
            return None

    return types


class Warehouse:
    """``strict_like``: LIKE has the dialect's wildcards (% and ?) and ignores case."""

    def __init__(self, spark: SparkSession, location: str, strict_like: bool = False):
        self.spark, self.strict_like = spark, strict_like
        self.catalog = Catalog(spark, location)
        self.functions: FunctionRegistry = builtins()
        self.history: list[str] = []

    def sql(self, text: str) -> DataFrame | None:
        """Run the statements of ``text``; the last one's rows, None if it has none."""
        out = None
        for ts in dialect.statements(text):
            self.history.append(dialect.text_of(ts))
            out = self._run(dialect.parse(ts))
        return out

    def query(self, ts: list[dialect.Token]) -> DataFrame:
        """The rows of a query. One table's rows of given values come through an index of theirs."""
        found = dialect.equalities(ts)
        if found and ts[found[0]].text.strip("`").lower() in self.catalog.names():
            at, equal = found
            name = ts[at].text.strip("`").lower()
            index = self.catalog.index_for(name, set(equal))
            if index is not None:
                aliased = at + 1 < len(ts) and ts[at + 1].word != "where"
                ts = [*ts[:at], dialect.Token("quoted", f"`{self.catalog.index_view(index)}`"), *([] if aliased else dialect.tokens(f"as {name}")), *ts[at + 1 :]]
        own = set(f.name.lower() for f in self.functions.listing()) - BUILT_IN
        functions = (own.__contains__, lambda name, takes: self.functions.sql(self.spark, name, takes))
        return self.spark.sql(dialect.rewrite(ts, typer(self.spark), self.strict_like, functions))

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _run(self, s: dialect.Statement) -> DataFrame | None:
        c = self.catalog
        if s.kind == "select":
            return self.query(s.query)
        if s.kind == "create":
            c.create(s.name, s.columns, s.fmt, s.location, s.options)
        elif s.kind == "create_as":
            c.create_as(s.name, self.query(s.query), s.fmt, s.location or None, s.options)
        elif s.kind == "create_index":
            c.create_index(s.name, s.table, s.keys, s.method, s.unique, s.options)
        elif s.kind == "insert":
            c.insert(s.name, self.query(s.query))
        elif s.kind in ("drop", "detach", "drop_index"):
            getattr(c, s.kind)(s.name)
        elif s.kind == "attach":
            c.attach(s.name, s.location)
        elif s.kind == "show_tables":
            return self._rows([(n,) for n in c.names()], "table_name string")
        elif s.kind == "describe":
            return self._rows(c.get(s.name).describe(), "column_name string, column_type string")
        elif s.kind == "show_functions":
            return self._rows([(f.name, ", ".join(f.takes), f.returns, f.kind) for f in self.functions.listing()], "name string, takes string, returns string, kind string")
        elif s.kind == "cluster":
            return self._rows([(self.spark.sparkContext.master, self.spark.sparkContext.defaultParallelism, self.spark.version)], "master string, cores int, version string")
        return None
