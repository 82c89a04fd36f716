"""Tables in files: delimited text with a declared schema, and columnar formats.

Every path goes through Spark's file systems, so a table may live in any store they open.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.types import dialect_type, from_text, to_text

FORMATS = ("csv", "parquet", "orc", "json")
#: Names that declarations use for row and columnar binary stores.
SYNONYMS = {"raw": "parquet", "rowfile": "parquet", "rcfile": "orc"}
DELIMITERS = ("csvfile.delimiter", "csv.delimiter", "sep")
#: The option of the character before an escaped delimiter (d), line feed (n), return (r) or itself.
#: Tables that are created from queries have it; without it a cell can't hold these.
ESCAPE = "csvfile.escape"


class FormatError(ValueError):
    """A format that tables can't have."""


def format_of(name: str) -> str:
    name = SYNONYMS.get(name.lower(), name.lower())
    if name not in FORMATS:
        raise FormatError(f"format {name!r}; known: {FORMATS + tuple(SYNONYMS)}")
    return name


def delimiter(options: dict[str, str]) -> str:
    return next((options[k] for k in DELIMITERS if k in options), "|")


def read(spark: SparkSession, path: str, fmt: str, schema: T.StructType, options: dict[str, str] | None = None) -> DataFrame:
    """A table of a declared schema. Text cells are trimmed; an empty or missing one is null, and
    cells beyond the schema are dropped."""
    if format_of(fmt) != "csv":
        return spark.read.format(format_of(fmt)).schema(schema).load(path)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    text = spark.read.schema(raw).csv(path, sep=delimiter(options or {}), quote="", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    plain = lambda c: _unescaped(c, options or {})
    return text.select(*[from_text(plain(F.col(f"`{f.name}`")), dialect_type(f)).alias(f.name, metadata=f.metadata) for f in schema])


def write(df: DataFrame, path: str, fmt: str, options: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    fmt = format_of(fmt)
    if fmt != "csv":
        df.write.mode(mode).format(fmt).save(path)
        return
    cells = df.select(*[_escaped(to_text(F.col(f"`{f.name}`"), dialect_type(f)), options or {}).alias(f.name) for f in df.schema])
    cells.write.mode(mode).csv(path, sep=delimiter(options or {}), quote="\u0000", emptyValue="")


def _escaped(cell: Column, options: dict[str, str]) -> Column:
    """A cell as it is written. Without an escape character a cell that would break its row raises."""
    mark, sep = options.get(ESCAPE), delimiter(options)
    if mark is None:
        broken = cell.contains("\n") | cell.contains("\r") | cell.contains(sep)
        return F.when(broken, F.raise_error(F.lit(f"a cell holds a line end or {sep!r}; set {ESCAPE!r}"))).otherwise(cell)
    for raw, name in ((mark, mark), ("\n", "n"), ("\r", "r"), (sep, "d")):
        cell = F.replace(cell, F.lit(raw), F.lit(mark + name))
    return cell


def _unescaped(cell: Column, options: dict[str, str]) -> Column:
    """The inverse: the parts between doubled marks are taken one by one, so that a mark that stands
    for itself doesn't join what follows it."""
    mark, sep = options.get(ESCAPE), delimiter(options)
    if mark is None:
        return cell

    def part(x: Column) -> Column:
        for raw, name in (("\n", "n"), ("\r", "r"), (sep, "d")):
            x = F.replace(x, F.lit(mark + name), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(cell, re.escape(mark * 2)), part), mark)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    p, fs = _hadoop(spark, path)
    return fs.getContentSummary(p).getLength()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small description beside a table."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
