"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace import dialect
from millrace.operators.scan import TABLES, parquet
from millrace.session import typer

Builder = Callable[[SparkSession, str], DataFrame]


class Plans:
    """The queries of one category."""

    def __init__(self) -> None:
        self.queries: dict[str, Builder] = {}
        self.oracles: dict[str, str] = {}

    def frame(self, key: str, oracle: str | None) -> Callable[[Callable], Builder]:
        """Registers a builder that gets a function from table names to DataFrames."""

        def wrap(build: Callable) -> Builder:
            self.queries[key] = lambda spark, sf_dir: build(lambda name: parquet(spark, sf_dir, name))
            if oracle:
                self.oracles[key] = oracle
            return build

        return wrap

    def sql(self, key: str, text: str, oracle: str | None = None, **options) -> None:
        """Registers dialect SQL; the oracle is the same text unless another is given."""
        self.queries[key] = lambda spark, sf_dir: run_sql(spark, sf_dir, text, **options)
        self.oracles[key] = oracle or text


def run_sql(spark: SparkSession, sf_dir: str, text: str, **options) -> DataFrame:
    ts = dialect.tokens(text)
    names = {t.word for t in ts}
    for name in TABLES:
        if name in names:
            parquet(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(dialect.rewrite(ts, typer(spark), **options))
