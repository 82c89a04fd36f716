import math
import re
from collections import Counter

import pytest

from millrace.llm import backoff, queries
from tests.llm.fixtures import empty, hard, hard_rows
from tests.oracle import compare, connection


def brute(rows):
    docs = [(r[0], [w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w]) for r in rows]
    uni, pre, bi = Counter(), Counter(), Counter()
    for _, w in docs:
        uni.update(w)
        pre.update(w)
        pre[None] += bool(w)
        bi.update(zip([None, *w], w, strict=False))
    total, out = sum(uni.values()), []
    for doc_id, w in docs:
        s = 0.0
        for u, v in zip([None, *w], w, strict=False):
            s += math.log(bi[u, v] / pre[u]) if bi[u, v] >= backoff.MIN_COUNT else math.log(backoff.ALPHA * uni[v] / total)
        out.append((doc_id, len(w), round(s, 3) + 0.0))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 3) + 0.0) for r in df.collect()), key=str)


@pytest.mark.parametrize(("sample", "words", "hot", "tokens"), [(2_000, 100_000, 5_000, 1_500_000), (20, 50, 9, 700), (2_000, 0, 0, 50)])
def test_hard_rows(spark, monkeypatch, sample, words, hot, tokens):
    """Whatever the dictionary, the hot bigrams and the flushes are, the scores are the same."""
    for name, value in (("SAMPLE", sample), ("WORDS", words), ("HOT", hot), ("FLUSH_TOKENS", tokens)):
        monkeypatch.setattr(backoff, name, value)
    got, want = shown(backoff.scores(hard(spark))), brute(hard_rows())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=0.002)


def test_empty_tables(spark):
    assert backoff.scores(empty(spark)).count() == 0
    assert shown(backoff.scores(spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string"))) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_query_and_oracle(spark, sf):
    assert compare(queries.op6_stupid_backoff(spark, sf), connection(sf), queries.ORACLES["op6_stupid_backoff"]) is None
