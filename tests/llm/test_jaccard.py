import random
import re

import pytest

import corpus_pipeline
from millrace.llm import jaccard
from tests.llm.fixtures import SCHEMA, empty, hard, hard_rows, sentence


def brute_shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_pairs(texts):
    """(i, j), i > j, of all that have a similarity of 0.8 at least."""
    sets = [brute_shingles(t) for t in texts]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return {(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])}


def brute_roots(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute_pairs(texts):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def parts(labels):
    out = {}
    for k, x in labels:
        out.setdefault(x, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_groups_of_all_documents_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert parts((r["doc_id"], r["root"]) for r in got) == parts(zip([i for i, _ in rows], brute_roots([t for _, t in rows]), strict=True))


def test_hard_rows(spark):
    rows = hard_rows()
    unique = {r[0]: r for r in rows if r[0] is not None}
    got = jaccard.near_duplicates(spark.createDataFrame(list(unique.values()), SCHEMA)).collect()
    assert parts((r["doc_id"], r["root"]) for r in got) == parts(zip(unique, brute_roots([r[1] for r in unique.values()]), strict=True))
    assert jaccard.near_duplicates(hard(spark)).count() == len(rows) and jaccard.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("small", "pivots", "block"), [(2, 6, 20)])
def test_large_groups_by_pivots(spark, sf, monkeypatch, small, pivots, block):
    """A chain of near copies, two stars that one text joins, and unlike texts with equal band keys."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(11), []
    for _ in range(3):
        words = sentence(rng, 150, 5000).split()
        for step in range(12):
            texts.append(" ".join(words))
            words[11 * step + 3] = f"c{step}"
        star = sentence(rng, 150, 5000).split()
        for k in range(10):
            copy = list(star)
            copy[rng.randrange(150)] = f"s{k}"
            copy[rng.randrange(150)] = f"t{k}"
            texts.append(" ".join(copy))
    texts += [" ".join(texts[0].split()[:k]) for k in range(60, 150, 6)]
    rows = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(rows * 2, "doc_id bigint, text string").repartition(3)).distinct().collect()
    assert parts((r["doc_id"], r["root"]) for r in got) == parts(zip(range(len(texts)), brute_roots(texts), strict=True))


def test_recall_near_the_threshold(spark, sf):
    """Copies with replaced words: each pair of 0.8 and more is found, and the stage keeps one of each."""
    rng, texts = random.Random(3), []
    for k in range(150):
        words = sentence(rng, 200, 5000).split()
        texts.append(" ".join(words))
        for at in rng.sample(range(200), 2 + k % 4):
            words[at] = f"n{k}x{at}"
        texts.append(" ".join(words))
    want = brute_roots(texts)
    assert 60 < len(texts) - len(set(want)) < 150  # both sides of the threshold
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == sorted(set(want))
