"""Joins with the standard meaning of each type, as Spark plans them.

Catalyst picks the algorithm (broadcast below ``spark.sql.autoBroadcastJoinThreshold``, else
sort-merge, with AQE's re-planning and skew splitting); ``strategy`` forces one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = {"broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}
TYPES = ("inner", "left", "right", "full", "semi", "anti")


class JoinError(ValueError):
    """Columns or a type that a join can't use."""


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    if how not in TYPES:
        raise JoinError(f"join type {how!r}; known: {TYPES}")
    if strategy:
        right = right.hint(STRATEGIES[strategy])
    return left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Equal on ``columns``, which come first and once."""
    missing = [c for c in columns if c not in left.columns or c not in right.columns]
    if missing:
        raise JoinError(f"not on both sides: {missing}")
    return left.join(right, columns, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equal on all columns of the same name, which must have the same type; they come first.
    Without such a column it is a cross join."""
    kinds = dict(right.dtypes)
    common = [c for c in left.columns if c in kinds]
    unlike = [c for c in common if dict(left.dtypes)[c] != kinds[c]]
    if unlike:
        raise JoinError(f"types differ: {unlike}")
    return using(left, right, common, how) if common else cross(left, right)


def union_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both sides, each padded with nulls: a full outer join in which no rows
    match, computed as a union, without comparing any."""
    l_pad = left.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema])
    r_pad = right.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema], "*")
    return l_pad.unionAll(r_pad)


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
