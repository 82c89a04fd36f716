import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import decontaminate, queries
from tests.llm.fixtures import empty, hard, hard_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    windows = {}
    for item_id, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item_id is None else str(item_id))
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r["doc"]["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in df.collect()), key=str)


def items(rng=None):
    rows = [(i, t) for i, t, *_ in hard_rows()]
    texts = [t for _, t in rows if t]
    words = [t.split() for t in texts if 30 < len(t.split()) < 400]
    out = [(1, None), (2, ""), (3, "..."), (4, "One"), (5, "DON'T we"), (6, "y y y"), (7, " ".join(words[0][3:22])), (8, " ".join(words[1][5:18]).upper()), (9, " ".join(words[2][5:17])), (10, " ".join(words[3][:5] + words[4][5:30] + ["x"] + words[4][30:44]))]
    out += [(11, " ".join(["same"] * 13)), (12, " ".join(["same"] * 40)), (13, "nothing of this is there"), (13, " ".join(words[5][2:16])), (None, " ".join(words[6][2:20]))]
    return out


def test_hard_rows(spark):
    bench = spark.createDataFrame([(i, t, "z") for i, t in items()], "item_id bigint, text string, words string").repartition(2)
    out = decontaminate.contaminated(hard(spark), bench)
    assert shown(out) == brute(hard_rows(), items())
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    none = decontaminate.contaminated(hard(spark), bench.limit(0))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(hard_rows())


def test_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "bounded", lambda df: df)
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    assert shown(decontaminate.contaminated(hard(spark), bench)) == brute(hard_rows(), items())


def test_few_words_repeat_in_many_ways(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    bench = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    # Whole windows of documents, so that there are hits.
    bench += [(100 + i, " ".join(docs[i][1].split()[5:30])) for i in range(6)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert shown(got) == brute(docs, bench)


def test_text_without_spans(spark):
    df = spark.createDataFrame([("One, two;  three four!", [(2, 4)]), ("a b", []), ("ß x", [(1, 2)])], "text string, spans array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(decontaminate.without(F.col("text"), F.col("spans"))).collect()] == ["One, ;   four!", "a b", " x"]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(docs, bench)
    assert sorted(map(tuple, queries.op2_winnowing_decontamination(spark, sf).collect()), key=str) == want
    assert any(r[5] for r in want)
