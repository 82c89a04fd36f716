"""Partitioned stores and index-like lookups.

An index is a copy of its table, range-partitioned and sorted on the key, whose row
groups carry the keys' minima and maxima (and a bloom filter, for hash-like methods): an
equality lookup opens few files and row groups. The description lives beside the copy.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import read_text, write_text

METHODS = ("bst", "btree", "hash", "bitmap")


class IndexingError(ValueError):
    """An index that can't be made or found."""


def hash_partitioned(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Rows of one key in one file; ``buckets`` files at most."""
    df.repartition(buckets, *keys).write.mode("overwrite").parquet(path)


def range_partitioned(df: DataFrame, path: str, keys: list[str], ranges: int) -> None:
    """Files that each hold one range of the key, sorted."""
    df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Key:
    """A key of an index, with its order."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(f"`{self.name}`")
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    keys: tuple[Key, ...]
    method: str
    unique: bool
    path: str
    options: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(k.name for k in self.keys)

    def saved(self, spark: SparkSession) -> None:
        write_text(spark, f"{self.path}.index.json", json.dumps(asdict(self)))


def load(spark: SparkSession, path: str) -> Index:
    raw = json.loads(read_text(spark, f"{path}.index.json"))
    return Index(**raw | {"keys": tuple(Key(**k) for k in raw["keys"])})


def _write(df: DataFrame, index: Index, mode: str) -> None:
    """Rows in files that each hold one range of the keys, in their order; the option ``ranges`` is
    their number."""
    order = [k.order() for k in index.keys]
    ranges = int(index.options.get("ranges", df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    writer = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode(mode)
    for k in index.columns if index.method in ("hash", "bitmap") else ():
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(index.path)


def _refuse_repeats(index: Index, df: DataFrame) -> None:
    """Keys of null may repeat."""
    whole = df.dropna(subset=list(index.columns))
    if index.unique and not whole.groupBy(*index.columns).count().where("count > 1").isEmpty():
        raise IndexingError(f"{index.name}: keys repeat")


def create(df: DataFrame, index: Index) -> Index:
    if index.method not in METHODS:
        raise IndexingError(f"method {index.method!r}; known: {METHODS}")
    missing = [k for k in index.columns if k not in df.columns]
    if missing:
        raise IndexingError(f"{index.table} has no column {missing}")
    _refuse_repeats(index, df)
    _write(df, index, "overwrite")
    index.saved(df.sparkSession)
    return index


def refuse(index: Index, rows: DataFrame) -> None:
    """Raises if rows that are to be added would repeat a key of a unique index."""
    _refuse_repeats(index, rows)
    if index.unique and not rows.join(rows.sparkSession.read.parquet(index.path), list(index.columns), "left_semi").isEmpty():
        raise IndexingError(f"{index.name}: keys repeat")


def add(index: Index, rows: DataFrame) -> None:
    """Rows added to the table, as further sorted files."""
    _write(rows, index, "append")
    rows.sparkSession.catalog.refreshByPath(index.path)


def lookup(spark: SparkSession, index: Index, **equal) -> DataFrame:
    """Rows whose keys have the given values; the filter is pushed to the sorted copy."""
    if set(equal) - set(index.columns):
        raise IndexingError(f"{index.name} has keys {index.columns}")
    return spark.read.parquet(index.path).where(key_filter(equal))


def chosen(indexes: list[Index], equal: set[str]) -> Index | None:
    """The index of the most keys, all of them compared for equality."""
    fit = [i for i in indexes if set(i.columns) <= equal]
    return max(fit, key=lambda i: len(i.keys), default=None)


def key_filter(values: dict[str, object]) -> Column:
    out = F.lit(True)
    for k, v in values.items():
        out = out & (F.col(k) == v)
    return out
