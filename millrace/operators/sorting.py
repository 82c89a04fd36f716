"""Order, limits and top-k. Nulls come last in both directions unless asked for first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(column: str | Column, descending: bool = False, nulls_first: bool = False) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def order(df: DataFrame, *keys: Column) -> DataFrame:
    """A total order over all partitions: sampled ranges, sorted and spilled by Spark."""
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int) -> DataFrame:
    """n rows of the whole result, not of each task."""
    return df.limit(n)


def top(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows of an order; each task keeps n rows and no full sort is made."""
    return df.orderBy(*keys).limit(n)
