"""Grouping, cubes and duplicate elimination. Spark aggregates partially before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group(df: DataFrame, keys: list[str | Column], *aggs: Column, having: Column | None = None) -> DataFrame:
    """Aggregates per group; without keys one row, also of an empty input."""
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return out if having is None else out.where(having)


def cube(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.cube(*keys).agg(*aggs)


def rollup(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.rollup(*keys).agg(*aggs)


def grouping_sets(df: DataFrame, sets: list[list[str]], *aggs: Column) -> DataFrame:
    """Aggregates for each set of keys, in one pass over the input; keys outside a set are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggs)


def count_distinct(df: DataFrame, keys: list[str], value: str, distinct: str, rows: str) -> DataFrame:
    """Three-phase grouping: by keys and value, so that a key of much of the input is dealt out by its
    values, then by the keys: the distinct values that aren't null, and the rows, of each key."""
    each = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__rows"))
    return each.groupBy(*keys).agg(F.count(value).alias(distinct), F.sum("__rows").alias(rows))


def distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()
