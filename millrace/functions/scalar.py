"""Scalar expressions whose dialect meaning differs from Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.types import promoted


def like_regex(pattern: str) -> str:
    """The regex of a dialect LIKE pattern: % is any run and ? any one character; all else,
    _ included, stands for itself. It matches whole values, over lines, in any case."""
    body = "".join(".*" if c == "%" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?is)^(?:{body})$"


def like(value: Column, pattern: str) -> Column:
    return value.rlike(like_regex(pattern))


def random_int(bound: int, seed: int | None = None) -> Column:
    """A uniform integer from 0 to below ``bound``."""
    return F.floor((F.rand() if seed is None else F.rand(seed)) * bound).cast("int")


def arithmetic(df: DataFrame, left: str, op: str, right: str) -> Column:
    """``left op right`` on numeric columns of ``df`` with the dialect's result type. Integer
    division truncates; dividing an integer by zero raises, as does overflow."""
    kinds = dict(df.dtypes)
    kind = promoted(kinds[left], kinds[right])
    a, b = F.col(left).cast(kind), F.col(right).cast(kind)
    integral = kind in ("smallint", "int", "bigint")
    if op == "/":
        return F.expr(f"cast(cast(`{left}` as bigint) div cast(`{right}` as bigint) as {kind})") if integral else F.try_divide(a, b).cast(kind)
    return {"+": a + b, "-": a - b, "*": a * b, "%": a % b}[op].cast(kind)
