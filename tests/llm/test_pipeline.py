import base64
import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality, queries
from tests.llm import test_decontaminate, test_jaccard, test_quality, test_substrings
from tests.llm.fixtures import empty, hard

NAMES = [name for name, _ in corpus_pipeline.STAGES]


def brute_near(rows):
    """The first row of each group, of ``rows`` in order of doc_id."""
    return [rows[k] for k in sorted(set(test_jaccard.brute_roots([r["text"] for r in rows])))]


def brute_substrings(rows, length=20):
    first, out = {}, []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        for i in range(len(w) - length + 1):
            first[tuple(w[i : i + length])] = min(first.get(tuple(w[i : i + length]), (1 << 62, 0)), (r["doc_id"], i))
    for r in rows:
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        w = [r["text"][a:b] for a, b in places]
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (r["doc_id"], i):
                gone.update(range(i, i + length))
        text, at, k = "", 0, 0
        while k < len(w):
            if k in gone:
                text += r["text"][at : places[k][0]]
                while k in gone:
                    k += 1
                at = places[k][0] if k < len(w) else len(r["text"])
            else:
                k += 1
        out.append({**r, "text": (text + r["text"][at:]) if gone else r["text"]})
    return out


def brute_leaks(rows, bench):
    judged = {x[0]: x for x in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in rows], bench)}
    return [r for r in rows if not judged[r["doc_id"]][5]], {i for i, x in judged.items() if x[2] and not x[5]}


def brute_ids(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = enc.encode_ordinary(r["text"] or "")
        out.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return sorted(out)


def test_stages_in_order():
    assert NAMES == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "encoding"]


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "encoding" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        given[name] = docs
        docs = spark.read.parquet(str(tmp_path / name))
    after = dict(zip(NAMES, [*(given[n] for n in NAMES[1:]), docs], strict=True))
    kept = {r["doc_id"] for r in quality.judged(given["quality_rules"]).where("kept").collect()}
    assert rows(after["quality_rules"]) == [r for r in rows(given["quality_rules"]) if r["doc_id"] in kept]
    assert rows(after["near_dedup"]) == brute_near(rows(given["near_dedup"]))
    assert rows(after["substring_dedup"]) == brute_substrings(rows(given["substring_dedup"]))
    want, cut = brute_leaks(rows(given["decontamination"]), bench)
    got = rows(after["decontamination"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    assert [r for r in got if r["doc_id"] not in cut] == [r for r in want if r["doc_id"] not in cut]
    assert sorted(map(tuple, docs.collect())) == brute_ids(got)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == brute_ids(got)


@pytest.mark.parametrize("name", NAMES)
def test_hard_and_empty_tables(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = hard(spark)
    got = stage(spark, docs, sf).collect()
    key = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    given = [r.asDict() for r in docs.collect()]
    if name == "quality_rules":
        verdicts = {(r["doc_id"], r["version"]) for r in quality.judged(docs).where("kept").collect()}
        versions = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).collect()
        assert key(got) == key(r for r in versions if (r["doc_id"], r["version"]) in verdicts)
        assert all(not test_quality.brute(r["text"])[5] for r in got) and got
    if name == "near_dedup":
        assert len({(r["doc_id"], r["text"]) for r in got}) == len(got) < docs.count()
        roots = test_jaccard.brute_roots([r["text"] for r in given])
        assert sorted(roots[k] for k in {next(k for k, g in enumerate(given) if (g["doc_id"], g["text"]) == (r["doc_id"], r["text"])) for r in got}) == sorted(set(roots))
    if name in ("substring_dedup", "encoding"):
        assert len(got) == docs.count()
    if name == "decontamination":
        bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
        clean = [r for r in given if not test_decontaminate.brute([(r["doc_id"], r["text"])], bench)[0][5]]
        assert key(got) == key(clean)
    if name == "encoding":
        texts = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in given]
        assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in got), key=str) == sorted(texts, key=str)
    assert stage(spark, empty(spark), sf).count() == 0


def test_repeated_windows_are_gone(spark, sf):
    out = corpus_pipeline.substring_dedup(spark, hard(spark).select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), sf)
    assert sum(x[2] for x in test_substrings.brute([tuple(r) for r in out.collect()], 60)) == 0
