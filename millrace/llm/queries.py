"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import backoff, bpe, decontaminate, hilbert, langid, oracles, quality, simhash, substrings, unigram, urls
from millrace.llm.store import table

SHARDS = 24
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("block", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]
UNIGRAM_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(table(spark, sf_dir, "documents"), SHARDS)


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality.FIELDS, "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.scores(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round(mean, 4).alias("score"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 OR toxic = 1").alias("bad"))
    out = urls.judged(table(spark, sf_dir, "pages"), labels, RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), UNIGRAM_VOCABULARY)


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_winnowing_decontamination, op3_language_id, op4_quality_rules, op5_byte_bpe, op6_stupid_backoff, op7_substring_dedup, op8_url_templates, op9_simhash_near_dedup, op10_token_counts)}
ORACLES: dict[str, str] = oracles.ORACLES | {"op8_url_templates": oracles.url_templates(RULES)}
