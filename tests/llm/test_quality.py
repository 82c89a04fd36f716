import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from millrace.llm import quality, queries
from tests.llm.fixtures import SCHEMA, empty, hard, hard_rows
from tests.oracle import compare, connection

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in SPACES.split(text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACES.sub("", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_counts_of_hard_rows(spark):
    got = quality.judged(hard(spark)).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in quality.FIELDS), r["base_failed"]) for r in got), key=str) == sorted(((i, *brute(t)) for i, t, *_ in hard_rows()), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.judged(empty(spark)).count() == 0


def test_oracle_on_hard_rows(spark, tmp_path):
    hard(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = quality.judged(spark.read.parquet(str(tmp_path / "documents.parquet"))).select("doc_id", *quality.FIELDS, "base_failed", "kept")
    assert compare(out, con, quality.ORACLE) is None


def test_buckets_keep_nine_bits(spark):
    values = [0, 1, 1023, 1024, 1025, 1030, 123_456, 10**12]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(quality.bucket(F.col("v"))).collect()]
    for v, b in zip(values, got, strict=True):
        assert b <= v and (v - b) * 512 <= v


def test_thresholds_follow_each_group(spark):
    """One source is full of symbols by nature: its documents stay, a like one elsewhere goes."""
    rng = random.Random(4)
    rows = []
    for i in range(200):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        if i % 2:
            words = [w + "#" * rng.randrange(1, 3) for w in words]
        rows.append((i, " ".join(words), "en", "code" if i % 2 else "prose", 1, *["z"] * 11))
    rows.append((999, rows[1][1], "en", "prose", 1, *["z"] * 11))
    rows.append((1000, rows[1][1], "en", "unseen source", 1, *["z"] * 11))
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(200)) and not got[999]


def test_query_and_oracle(spark, sf):
    assert compare(queries.op4_quality_rules(spark, sf), connection(sf), queries.ORACLES["op4_quality_rules"]) is None
