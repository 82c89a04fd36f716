"""User functions by name and argument types.

A scalar function is either a composition of Spark expressions (a Python callable on
columns) or a vectorised Python function on pandas series. An aggregate function is given by its
partial state, merge and final expression, all of which Spark runs as partial aggregation, or
by a pandas grouped aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ipv4
from millrace.types import RANK, TYPES


class FunctionError(LookupError):
    """No function of that name takes these types, or one is defined twice."""


@dataclass(frozen=True)
class Function:
    name: str
    takes: tuple[str, ...]
    returns: str
    kind: str  # scalar or aggregate
    build: Callable[..., Column]
    python: bool = False


def _spark_name(kind: str) -> str:
    return TYPES[kind].simpleString() if kind in TYPES else kind


class FunctionRegistry:
    def __init__(self) -> None:
        self._known: dict[tuple[str, tuple[str, ...]], Function] = {}

    def add(self, f: Function) -> Function:
        key = (f.name.lower(), tuple(map(_spark_name, f.takes)))
        if key in self._known:
            raise FunctionError(f"{f.name}{f.takes} is already defined")
        self._known[key] = f
        return f

    def scalar(self, name: str, takes: list[str], returns: str, build: Callable[..., Column]) -> Function:
        """A function that composes Spark expressions."""
        return self.add(Function(name, tuple(takes), returns, "scalar", build))

    def pandas_scalar(self, name: str, takes: list[str], returns: str, body: Callable) -> Function:
        """A function of pandas series, run over Arrow batches."""
        return self.add(Function(name, tuple(takes), returns, "scalar", F.pandas_udf(body, _spark_name(returns)), True))

    def aggregate(self, name: str, takes: list[str], returns: str, state: Callable[..., dict[str, Column]], final: Callable[..., Column]) -> Function:
        """``state`` gives built-in aggregates of the arguments by name, ``final`` an expression
        of them; Spark computes the state partially before it shuffles."""

        def build(*args: Column) -> Column:
            return final(**state(*args)).cast(_spark_name(returns))

        return self.add(Function(name, tuple(takes), returns, "aggregate", build))

    def pandas_aggregate(self, name: str, takes: list[str], returns: str, body: Callable) -> Function:
        """A grouped aggregate over pandas series; a whole group must fit a task."""
        return self.add(Function(name, tuple(takes), returns, "aggregate", F.pandas_udf(body, _spark_name(returns)), True))

    def drop(self, name: str, takes: list[str]) -> None:
        if self._known.pop((name.lower(), tuple(map(_spark_name, takes))), None) is None:
            raise FunctionError(f"{name}({', '.join(takes)}) is not defined")

    def resolve(self, name: str, takes: list[str]) -> Function:
        f = self._known.get((name.lower(), tuple(map(_spark_name, takes))))
        if f is None:
            known = sorted(", ".join(k[1]) for k in self._known if k[0] == name.lower())
            raise FunctionError(f"{name}({', '.join(takes)}) is not defined" + (f"; known: {known}" if known else ""))
        return f

    def call(self, df, name: str, *columns: str) -> Column:
        """The overload of ``name`` for the types that ``columns`` have in ``df``, applied."""
        kinds = dict(df.dtypes)
        return self.resolve(name, [kinds[c] for c in columns]).build(*map(F.col, columns))

    def resolve_widened(self, name: str, takes: list[str]) -> Function:
        """The overload of these types, or else that which widens numbers the least."""
        key = (name.lower(), tuple(map(_spark_name, takes)))
        if key not in self._known:
            found = []
            for (n, wants), f in self._known.items():
                if n == key[0] and len(wants) == len(takes) and all(a == b or {a, b} <= set(RANK) and RANK.index(a) < RANK.index(b) for a, b in zip(key[1], wants, strict=True)):
                    found.append((sum(RANK.index(b) - RANK.index(a) for a, b in zip(key[1], wants, strict=True) if a != b), wants, f))
            if found:
                return min(found, key=lambda x: x[:2])[2]
        return self.resolve(name, takes)

    def sql(self, spark: SparkSession, name: str, takes: list[str]) -> list[str]:
        """The overload of ``name`` for these types as SQL text, cut where its arguments go: the parts
        between them, and at odd places an argument's number."""
        f = self.resolve_widened(name, takes)
        own = [f"__argument_{i}" for i in range(len(takes))]
        if f.python:
            called = "__" + "_".join([f.name.lower(), *map(_spark_name, f.takes)])
            spark.udf.register(called, f.build)
            text = f"{called}({', '.join(own)})"
        else:
            row = spark.sql("select " + ", ".join(f"cast(null as {t}) as {a}" for t, a in zip(map(_spark_name, f.takes), own, strict=True)) if own else "select 1")
            built = row.select(f.build(*map(F.col, own)).alias("__value"))
            text = built._jdf.queryExecution().analyzed().expressions().head().child().sql()
        return re.split(r"`?__argument_(\d+)`?", text)

    def listing(self) -> list[Function]:
        return sorted(self._known.values(), key=lambda f: (f.name, f.takes))


def builtins() -> FunctionRegistry:
    """The functions that every session knows: sum, max, min, avg, count and random, and those on
    packed addresses."""
    r = FunctionRegistry()
    for kind, total in (("int", "bigint"), ("long", "bigint"), ("float", "double"), ("double", "double")):
        r.aggregate("sum", [kind], total, lambda c: {"s": F.sum(c)}, lambda s: s)
        r.aggregate("max", [kind], kind, lambda c: {"m": F.max(c)}, lambda m: m)
        r.aggregate("min", [kind], kind, lambda c: {"m": F.min(c)}, lambda m: m)
        r.aggregate("avg", [kind], "double", lambda c: {"s": F.sum(c.cast("double")), "n": F.count(c)}, lambda s, n: F.try_divide(s, n))
    r.aggregate("max", ["string"], "string", lambda c: {"m": F.max(c)}, lambda m: m)
    r.aggregate("min", ["string"], "string", lambda c: {"m": F.min(c)}, lambda m: m)
    for kind in ("bool", "bytes", "short", "int", "long", "float", "double", "string"):
        r.aggregate("count", [kind], "bigint", lambda c: {"n": F.count(c)}, lambda n: n)
    r.aggregate("count", [], "bigint", lambda: {"n": F.count(F.lit(1))}, lambda n: n)
    r.scalar("random", ["int"], "int", lambda n: F.floor(F.rand() * n).cast("int"))
    r.scalar("ipv4_pack", ["string"], "long", ipv4.pack)
    r.scalar("ipv4_unpack", ["long"], "string", ipv4.unpack)
    r.scalar("ipv4_in_subnet", ["long", "long", "int"], "bool", lambda ip, net, bits: F.call_function("shiftright", ip.bitwiseXOR(net), F.lit(32) - bits) == 0)
    return r
