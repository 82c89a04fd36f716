"""Scans: projection and selection reach the reader, which prunes columns and row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(source: DataFrame, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    out = source if where is None else source.where(where)
    return out.select(*columns) if columns else out


def constants(spark: SparkSession, **values) -> DataFrame:
    """One row of expressions without a table."""
    return spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])
