"""Declared column types: names of the dialect, their Spark types, and their CSV forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import ipv4

#: Dialect name -> Spark type. byte is one raw byte, ipv4 a packed address.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "byte": T.BinaryType(),
    "char": T.StringType(),
    "bytes": T.BinaryType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "ipv4": T.LongType(),
    "ipv6": T.BinaryType(),
}


class SchemaError(ValueError):
    """A declaration that names an unknown type or a column twice."""


def normalise(name: str) -> str:
    return name.lower()


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    """Declared (name, dialect type) pairs as a Spark schema. Names are lower-cased and must
    differ; the dialect type stays in each field's metadata."""
    fields, seen = [], set()
    for name, kind in columns:
        name, kind = normalise(name), kind.lower()
        if kind not in TYPES:
            raise SchemaError(f"unknown type {kind!r} of column {name!r}")
        if name in seen:
            raise SchemaError(f"column {name!r} is declared twice")
        seen.add(name)
        fields.append(T.StructField(name, TYPES[kind], True, {"dialect": kind}))
    return T.StructType(fields)


def dialect_type(field: T.StructField) -> str:
    if "dialect" in field.metadata:
        return field.metadata["dialect"]
    return next((k for k, t in TYPES.items() if t == field.dataType and k not in ("byte", "char")), field.dataType.simpleString())


def from_text(cell: Column, kind: str) -> Column:
    """A CSV cell as a value: empty cells are null, bytes are base64, addresses dotted."""
    cell = F.when(cell == "", F.lit(None)).otherwise(cell)
    if kind in ("byte", "bytes", "ipv6"):
        return F.unbase64(cell)
    if kind == "ipv4":
        return ipv4.pack(cell)
    if kind == "char":
        return F.substring(cell, 1, 1)
    return cell.cast(TYPES[kind])


def to_text(value: Column, kind: str) -> Column:
    """The inverse of ``from_text``; nulls are empty cells."""
    if kind in ("byte", "bytes", "ipv6"):
        text = F.base64(value)
    elif kind == "ipv4":
        text = ipv4.unpack(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


#: Order of promotion of numeric operands.
RANK = ["smallint", "int", "bigint", "float", "double"]


def promoted(left: str, right: str) -> str:
    """Result type of arithmetic on two numeric types: the wider of both, except that float
    with anything but an integer of at most 32 bits is double."""
    a, b = sorted((left, right), key=RANK.index)
    if b == "float" and a in ("bigint", "float"):
        return "double"
    return b
