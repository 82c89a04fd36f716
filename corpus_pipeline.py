"""The corpus pipeline: rules, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes all that the one before it kept. ``run`` writes each stage's documents to the
shared folder and reads them again, so a lost executor never costs more than the stage at work.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard, quality, queries, substrings
from millrace.llm.store import mark, released, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are. A null text has no words and goes; rows that repeat are
    judged alike."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whose five-word shingles have a similarity of
    0.8 or more: that of the smallest doc_id, a null id being larger than any. Texts without words
    are one group; of rows that repeat as a whole one stays."""
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that also start earlier; a null text stays null. A row that
    repeats with its id isn't earlier than itself."""
    out = substrings.remove_repeats(docs)
    return out.select(*[F.col("left").alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; single hits in long ones are cut out. Null texts
    have no words and stay; rows that repeat are judged alike."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids, and of the bytes they decode to, of each row; a null text is empty."""
    return bpe.digest(bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = released(docs, f"stage-{name}", since)
    return docs


#: The encoding can't be expressed in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None
