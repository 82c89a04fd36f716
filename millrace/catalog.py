"""Named tables: declared, attached, created from queries, described and dropped.

A table's description (schema, format, options, statistics) is a JSON file beside its data,
so another session can attach the folder. Tables are temporary views to Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import layout
from millrace.sources import files
from millrace.types import dialect_type, normalise, schema_of


#: The store type of tables that are held in memory.
MEMORY = "mem"


class CatalogError(LookupError):
    """A table or index that is missing, or exists already."""


@dataclass
class Table:
    name: str
    schema: T.StructType
    path: str | None = None  # None: a view of a DataFrame
    fmt: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    stats: dict = field(default_factory=dict)
    indexes: list[str] = field(default_factory=list)  # their paths

    def describe(self) -> list[tuple[str, str]]:
        return [(f.name, dialect_type(f)) for f in self.schema]

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "schema": self.schema.jsonValue(), "format": self.fmt, "options": self.options, "stats": self.stats, "indexes": self.indexes})


def _measures(schema: T.StructType) -> list[Column]:
    """Rows, and per column nulls, minimum, maximum and an approximate count of distinct values."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(_plain(schema)):
        c = F.col(f"`{f.name}`")
        aggs += [F.count_if(c.isNull()).alias(f"nulls{i}"), F.min(c).cast("string").alias(f"min{i}"), F.max(c).cast("string").alias(f"max{i}"), F.approx_count_distinct(c).alias(f"ndv{i}")]
    return aggs


def _plain(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def _named(got: dict, schema: T.StructType) -> dict:
    return {"rows": got["rows"], "columns": {f.name: {k: got[f"{k}{i}"] for k in ("nulls", "min", "max", "ndv")} for i, f in enumerate(_plain(schema))}}


def statistics(df: DataFrame) -> dict:
    """The statistics of a DataFrame, in one pass."""
    return _named(df.agg(*_measures(df.schema)).first().asDict(), df.schema)


def observed(df: DataFrame) -> tuple[DataFrame, Callable[[], dict]]:
    """``df``, and its statistics once it has been written: they are taken on the way."""
    seen = Observation()
    return df.observe(seen, *_measures(df.schema)), lambda: _named(seen.get, df.schema)


def merged(old: dict, new: dict, schema: T.StructType) -> dict:
    """Statistics of two sets of rows together. The count of distinct values is that of the set which
    has more: a lower bound until the table is analysed."""
    if "rows" not in old or "columns" not in old:
        return {}
    kinds, columns = {f.name: f.dataType for f in schema}, {}
    for name, a in old["columns"].items():
        b = new["columns"][name]
        value = float if isinstance(kinds[name], T.NumericType) else str
        ends = {end: pick((x[end] for x in (a, b) if x[end] is not None), key=value, default=None) for end, pick in (("min", min), ("max", max))}
        columns[name] = {"nulls": a["nulls"] + b["nulls"], **ends, "ndv": max(a["ndv"], b["ndv"])}
    return {"rows": old["rows"] + new["rows"], "columns": columns}


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self._tables: dict[str, Table] = {}
        self._indexes: dict[str, layout.Index] = {}

    # tables
    def names(self) -> list[str]:
        return sorted(self._tables)

    def get(self, name: str) -> Table:
        try:
            return self._tables[normalise(name)]
        except KeyError:
            raise CatalogError(f"no table {name!r}") from None

    def frame(self, name: str) -> DataFrame:
        return self.spark.table(self.get(name).name)

    def _enter(self, t: Table) -> Table:
        if t.name in self._tables:
            raise CatalogError(f"table {t.name!r} exists")
        self._tables[t.name] = t
        if t.path is not None:
            self._view(t)
        return t

    def _view(self, t: Table) -> None:
        files.read(self.spark, t.path, t.fmt, t.schema, t.options).createOrReplaceTempView(t.name)

    def _save(self, t: Table) -> None:
        t.indexes = [i.path for i in self.indexes(t.name)]
        files.write_text(self.spark, f"{t.path}.table.json", t.to_json())

    def register(self, name: str, df: DataFrame, held: bool = False) -> Table:
        """A view of a DataFrame as a table; ``held``: its rows are kept in the executors' memory, and on
        their disks where that is short, and can be added to."""
        t = self._enter(Table(normalise(name), df.schema, fmt=MEMORY if held else "view"))
        (df.persist() if held else df).createOrReplaceTempView(t.name)
        return t

    def create(self, name: str, columns: list[tuple[str, str]], fmt: str, location: str, options: dict[str, str] | None = None) -> Table:
        """A table over the files at ``location``, which may not exist yet."""
        if fmt == MEMORY:
            return self.register(name, self.spark.createDataFrame([], schema_of(columns)), held=True)
        t = Table(normalise(name), schema_of(columns), location, files.format_of(fmt), dict(options or {}))
        if not files.exists(self.spark, location):
            files.write(self.spark.createDataFrame([], t.schema), location, t.fmt, t.options)
        t.stats = {"bytes": files.size(self.spark, location)}
        self._enter(t)
        self._save(t)
        return t

    def create_as(self, name: str, df: DataFrame, fmt: str = "parquet", location: str | None = None, options: dict[str, str] | None = None) -> Table:
        """A table of a query's rows; columns without a name get one."""
        name = normalise(name)
        if name in self._tables:
            raise CatalogError(f"table {name!r} exists")
        names = [normalise(c) if c.isidentifier() else f"column{i}" for i, c in enumerate(df.columns)]
        df = df.toDF(*names)
        if fmt == MEMORY:
            return self.register(name, df, held=True)
        options = dict(options or {}) | ({files.ESCAPE: "\\"} if fmt == "csv" and files.ESCAPE not in (options or {}) else {})
        t = Table(name, schema_of([(f.name, dialect_type(f)) for f in df.schema]) if files.format_of(fmt) == "csv" else df.schema, location or f"{self.warehouse}/{name}", files.format_of(fmt), options)
        df, stats = observed(df)
        files.write(df, t.path, t.fmt, t.options)
        t.stats = stats() | {"bytes": files.size(self.spark, t.path)}
        self._enter(t)
        self._save(t)
        return t

    def attach(self, name: str, path: str) -> Table:
        """The table that an earlier session left at ``path``, with its indexes."""
        raw = json.loads(files.read_text(self.spark, f"{path}.table.json"))
        t = self._enter(Table(normalise(name), T.StructType.fromJson(raw["schema"]), path, raw["format"], raw["options"], raw["stats"]))
        for where in raw.get("indexes", []):
            index = layout.load(self.spark, where)
            if index.name not in self._indexes:
                self._indexes[index.name] = replace(index, table=t.name)
        return t

    def detach(self, name: str) -> None:
        """Forget a table and its indexes; their files stay."""
        t = self.get(name)
        for i in self.indexes(t.name):
            self._forget(i)
        del self._tables[t.name]
        if t.fmt == MEMORY:
            self.spark.table(t.name).unpersist()
        self.spark.catalog.dropTempView(t.name)

    def drop(self, name: str) -> None:
        """Forget a table and delete its files and indexes."""
        t = self.get(name)
        for i in self.indexes(t.name):
            self.drop_index(i.name)
        self.detach(name)
        if t.path is not None:
            files.delete(self.spark, t.path)
            files.delete(self.spark, f"{t.path}.table.json")

    def insert(self, name: str, df: DataFrame) -> None:
        """Append rows, by position; the table's indexes get them as well."""
        t = self.get(name)
        rows = df.toDF(*t.schema.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in t.schema])
        if t.fmt == MEMORY:
            old = self.frame(name)
            all_ = old.union(rows).persist()
            all_.count()  # before the old rows go
            self.spark.catalog.dropTempView(t.name)
            all_.createOrReplaceTempView(t.name)
            return
        if t.path is None:
            raise CatalogError(f"{name!r} is a view")
        indexes = self.indexes(t.name)
        for i in indexes:
            layout.refuse(i, rows)
        seen, stats = observed(rows)
        files.write(seen, t.path, t.fmt, t.options, mode="append")
        for i in indexes:
            layout.add(i, rows)
        self.spark.catalog.refreshByPath(t.path)
        self._view(t)
        t.stats = merged(t.stats, stats(), t.schema) | {"bytes": files.size(self.spark, t.path)}
        self._save(t)

    def analyse(self, name: str) -> dict:
        t = self.get(name)
        t.stats = statistics(self.frame(name)) | ({"bytes": files.size(self.spark, t.path)} if t.path else {})
        if t.path:
            self._save(t)
        return t.stats

    # indexes
    def create_index(self, name: str, table: str, keys: list[layout.Key], method: str = "bst", unique: bool = False, options: dict[str, str] | None = None) -> layout.Index:
        """A sorted copy of a table that lookups of its keys read. Of a view it is a copy of the rows of now."""
        name, t = normalise(name), self.get(table)
        if name in self._indexes:
            raise CatalogError(f"index {name!r} exists")
        keys = [replace(k, name=normalise(k.name)) for k in keys]
        base = f"{t.path}.index" if t.path else f"{self.warehouse}/.index"
        index = layout.create(self.frame(table), layout.Index(name, t.name, tuple(keys), method, unique, f"{base}/{name}", dict(options or {})))
        self._indexes[name] = index
        if t.path:
            self._save(t)
        return index

    def indexes(self, table: str | None = None) -> list[layout.Index]:
        return [i for i in self._indexes.values() if table is None or i.table == normalise(table)]

    def _forget(self, index: layout.Index) -> None:
        del self._indexes[index.name]
        self.spark.catalog.dropTempView(f"__index_{index.name}")

    def drop_index(self, name: str) -> None:
        index = self._indexes.get(normalise(name))
        if index is None:
            raise CatalogError(f"no index {name!r}")
        self._forget(index)
        files.delete(self.spark, index.path)
        files.delete(self.spark, f"{index.path}.index.json")
        t = self._tables.get(index.table)
        if t is not None and t.path:
            self._save(t)

    def index_for(self, table: str, equal: set[str]) -> layout.Index | None:
        """The index of the most keys among the columns that are compared for equality."""
        return layout.chosen(self.indexes(table), equal)

    def index_view(self, index: layout.Index) -> str:
        """The name of a view of an index's rows, which are the table's."""
        self.spark.read.schema(self.get(index.table).schema).parquet(index.path).createOrReplaceTempView(f"__index_{index.name}")
        return f"__index_{index.name}"

    def find(self, table: str, **equal) -> DataFrame:
        """Rows of the given values, through an index if there is one for them."""
        index = self.index_for(table, set(equal))
        source = self.frame(table) if index is None else self.spark.table(self.index_view(index))
        return source.where(layout.key_filter(equal))
