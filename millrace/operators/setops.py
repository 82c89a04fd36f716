"""Set operations on inputs of equal types, by position."""

from __future__ import annotations

from pyspark.sql import DataFrame


class SetError(ValueError):
    """Inputs whose columns don't agree."""


def _checked(a: DataFrame, b: DataFrame) -> None:
    if [t for _, t in a.dtypes] != [t for _, t in b.dtypes]:
        raise SetError(f"types differ: {a.dtypes} and {b.dtypes}")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    _checked(a, b)
    return a.unionAll(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_all(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    _checked(a, b)
    return a.intersectAll(b) if all_rows else a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    _checked(a, b)
    return a.exceptAll(b) if all_rows else a.subtract(b)
