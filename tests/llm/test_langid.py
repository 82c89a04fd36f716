import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import langid, queries
from tests.llm.fixtures import SCHEMA, empty, hard, hard_rows


def brute_grams(text, p):
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    letters = letters[:1] + "".join(b for a, b in zip(letters, letters[1:], strict=False) if a != " " or b != " ")
    out = Counter()
    for n in p.orders:
        for i in range(len(letters) - n + 1):
            h = 0
            for c in letters[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            out[(h >> 8) % 2**p.bits] += 1
    return out


def brute_values(text, idf, p):
    x = {f: (1 + math.log(n)) * idf[f] for f, n in brute_grams(text, p).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {f: v / norm for f, v in x.items()} | {2**p.bits: 1.0}


def brute_softmax(x, w, langs, t=1.0):
    logits = [sum(v * w.get((f, k), 0.0) for f, v in x.items()) / t for k in range(len(langs))]
    e = [math.exp(z - max(logits)) for z in logits]
    return [z / sum(e) for z in e], logits


def brute_model(rows, p):
    """(langs, idf, weights, examples that calibrate)."""
    rows = [(t, lang) for t, lang in rows if lang is not None and t is not None and any(map(str.isalpha, t))]
    df = Counter(f for t, _ in rows for f in brute_grams(t, p))
    idf = {f: math.log((1 + len(rows)) / (1 + df[f])) + 1 for f in range(2**p.bits)}
    order = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) % 2**64 % 2**40
    langs = sorted({lang for _, lang in rows})
    examples = sorted((place, lang, t) for lang in langs for place, t in enumerate(sorted({t for t, x in rows if x == lang}, key=order), 1))
    z, n = Counter(), Counter()

    def weight(key):
        s = z[key]
        return 0.0 if abs(s) <= p.l1 else -(s - math.copysign(p.l1, s)) / ((p.beta + math.sqrt(n[key])) / p.alpha + p.l2)

    values = {t: brute_values(t, idf, p) for _, _, t in examples}
    for _ in range(p.epochs):
        for place, lang, t in examples:
            if place % 5:
                w = {(f, k): weight((f, k)) for f in values[t] for k in range(len(langs))}
                prob, _ = brute_softmax(values[t], w, langs)
                for k in range(len(langs)):
                    for f, v in values[t].items():
                        g = v * (prob[k] - (langs[k] == lang))
                        z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / p.alpha * w[f, k]
                        n[f, k] += g * g
    return langs, idf, {key: weight(key) for key in list(z)}, [(values[t], langs.index(lang)) for place, lang, t in examples if place % 5 == 0]


def test_model_and_predictions_against_brute_force(spark):
    """On the hard table: nulls, texts without letters, ties, repeated rows, long texts and clashing columns."""
    p = langid.Params(bits=7, epochs=2)
    # The hash of a text beyond 40 bits is Spark's, signed; the remainder is the same.
    rows = [(t, lang) for _, t, lang, *_ in hard_rows()]
    langs, idf, w, held = brute_model(rows, p)
    m = langid.fit(hard(spark), p)
    assert list(m.langs) == langs and m.idf == pytest.approx([idf[f] for f in range(128)], abs=1e-5)
    assert m.weights == pytest.approx(np.array([[w.get((f, k), 0.0) for k in range(len(langs))] for f in range(129)]), abs=1e-4)
    logits = np.array([brute_softmax(x, w, langs)[1] for x, _ in held])
    t = langid.temperature(logits, np.array([k for _, k in held]))
    assert m.temperature == pytest.approx(t, rel=0.01)
    want = []
    for i, text, *_ in hard_rows():
        if text is None or not any(map(str.isalpha, text)):
            want.append((i, "und", 0.0))
        else:
            prob, _ = brute_softmax(brute_values(text, idf, p), w, langs, m.temperature)
            want.append((i, langs[prob.index(max(prob))], max(prob)))
    got = sorted((tuple(r) for r in langid.predict(hard(spark), m).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    want.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-3)


def test_held_out_third(spark):
    ids = [*range(-50, 400), None, 2**62]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_sample_of_repeated_and_long_texts(spark):
    """Every language has its share of texts, however often one repeats and however long they are."""
    rows = [("the same text", "en")] * 3000 + [(f"text number {i}", "en") for i in range(40)] + [("lang " * 20_000 + str(i), "de") for i in range(30)] + [(f"un {i}", f"x{i % 50}") for i in range(500)]
    got = langid.sampled(spark.createDataFrame(rows, "text string, lang string").repartition(4), langid.Params(per_lang=25, rows=520)).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 10, "de": 10} | {f"x{k}": 10 for k in range(50)}


def test_features_are_counts_of_hashed_grams():
    p = langid.Params(bits=12)
    at, n = langid.grams("Abab, ab", p)
    assert n.sum() == sum(len(" abab ab ") - k + 1 for k in p.orders)
    assert list(langid.grams("ABAB ... ab", p)[0]) == list(at)


def test_l1_penalty_leaves_weights_at_zero():
    p = langid.Params(bits=4, l1=5.0)
    x = (np.array([1, 2, 16]), np.array([0.6, 0.8, 1.0]))
    assert not langid.ftrl([(*x, 0), (*x, 1)], 2, p).any()
    assert langid.ftrl([(*x, 0)], 2, langid.Params(bits=4)).any()


def test_temperature_softens_wrong_confidence():
    logits = np.array([[9.0, 0.0]] * 10)
    assert langid.temperature(logits, np.array([0] * 6 + [1] * 4)) > 5
    assert langid.temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_undetermined_and_unknown(spark):
    m = langid.fit(hard(spark))
    assert set(m.langs) == {"en", "fr"}
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 .."), (4, "the of")], "doc_id bigint, text string"), m).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3)) and got[4][0] in m.langs and 0 < got[4][1] <= 1
    none = langid.fit(empty(spark))
    assert none.langs == () and {r["lang_pred"] for r in langid.predict(hard(spark), none).collect()} == {"und"}
    assert langid.predict(empty(spark), m).count() == 0
    assert "score" in SCHEMA.names


def test_held_out_accuracy(spark, sf):
    truth = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()))
    got = [r for r in queries.op3_language_id(spark, sf).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(got) > 30
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
