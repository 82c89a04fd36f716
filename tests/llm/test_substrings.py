import hashlib
import random
import re

from millrace.llm import queries, substrings
from tests.llm.fixtures import empty, hard, hard_rows


def brute(rows, length=20):
    """(doc_id, n_words, n_removed, kept_sha256), from all windows."""
    first, docs = {}, []
    for doc_id, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        docs.append((doc_id, words))
        for i in range(len(words) - length + 1):
            w, at = tuple(words[i : i + length]), (doc_id is None, doc_id or 0, i)
            first[w] = min(first.get(w, at), at)
    out = []
    for doc_id, words in docs:
        gone = set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < (doc_id is None, doc_id or 0, i):
                gone.update(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r["doc"]["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=str)


def test_hard_rows(spark):
    out = substrings.remove_repeats(hard(spark)).cache()
    assert shown(out) == brute(hard_rows())
    assert {"lang", "source", "place", "anchor", "spans"} <= set(out.schema["doc"].dataType.names)
    for r in out.collect():
        assert (r["left"] or "").split() == bytes(r["kept"]).decode().split() or " " in r["left"] or "\x85" in r["left"]
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_parts_shared_in_many_ways(spark):
    """Random texts over few words, with windows shared by only some members of a seed."""
    rng = random.Random(11)
    blocks = [[rng.choice("abcdef") for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 9)) for w in rng.choice(blocks))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert shown(substrings.remove_repeats(df)) == brute(rows)
    assert shown(substrings.remove_repeats(df, length=7, k=3)) == brute(rows, 7)


def test_large_lists_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_NUMBERS", 1)
    assert shown(substrings.remove_repeats(hard(spark).select("doc_id", "text"))) == brute(hard_rows())


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op7_substring_dedup(spark, sf).collect()), key=str) == brute(rows)
