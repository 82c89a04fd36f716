"""Tables that cut lineage, and reading of the input tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the session names none and runs in one process,
    as in tests, a temporary one is made."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


#: Paths that ``written`` made and nothing has deleted yet, the oldest first.
_made: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: later plans read the files, so lost
    executors cost no recomputation of what led to them. Removed by ``released``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The place after the tables that are written by now."""
    return len(_made)


def released(df: DataFrame, label: str, since: int) -> DataFrame:
    """``df`` as a table, after which all other tables that were written since that mark are deleted."""
    out = written(df, label)
    for path in _made[since:-1]:
        p, fs = _hadoop(df.sparkSession, path)
        fs.delete(p, True)
    del _made[since:-1]
    return out


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows, and bytes in memory, up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _bytes(c: Column, kind: T.DataType) -> Column:
    """What a value takes in memory, roughly; an array's elements are taken to be of fixed size, or texts."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0)) + 16
        if isinstance(kind.elementType, T.ArrayType):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + 16 * F.coalesce(F.size(x), F.lit(0))), F.lit(0)) + 16
        wide = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return F.greatest(F.size(c), F.lit(0)) * wide + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows and bytes are within the bounds; else as it
    is, to be joined by shuffle."""
    own = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("bigint")
    got = df.limit(rows + 1).select(own.alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and got["b"] <= size else df


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``dropped`` (doc_id, version: xxhash64 of the text)."""
    keys = bounded(written(dropped.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct(), "dropped-rows"))
    return docs.join(keys, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version")), "left_anti")
