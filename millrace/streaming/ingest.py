"""Incremental loading of files into a table with Structured Streaming.

The relational engine is a batch engine; this keeps a table of it up to date. Each new file is
read once; the offsets in the checkpoint folder make a restarted load go on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def append_available(source: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append all that is there now, then stop."""
    source.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(source: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and key; rows later than ``late`` are left out once a window is closed."""
    return source.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
