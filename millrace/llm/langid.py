"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader (FTRL-proximal) and elastic-net
penalties, then calibrated by one temperature.

Document frequencies come from every training row. The weights are fitted on the driver on
a bounded sample: for each language, of which none is left out, the training texts of the smallest
hashes, at most ``per_lang`` and, over all languages, about ``rows``; every fifth of them serves for
calibration. Only their features are sent to the driver. A text found in several rows of a language
is one of its examples. Prediction covers all rows and whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import written

UNDETERMINED = "und"
#: N-grams of a text from which on they are counted in an array of all features rather than sorted.
DENSE = 4_000


@dataclass(frozen=True)
class Params:
    bits: int = 16  # features: hashed n-grams
    orders: tuple[int, ...] = (1, 2, 3)
    per_lang: int = 600  # bound of the sample, in texts of each language
    rows: int = 20_000  # bound of the sample over all languages, of which each has 10 texts in any case
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray  # (features,)
    weights: np.ndarray  # (features + 1, langs); the last row is the bias
    temperature: float
    params: Params


def grams(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a lower-cased text in which each run of non-letters is one space:
    (features, counts)."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(code)
    keep = letter | np.concatenate(([True], letter[:-1]))
    code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    h, found = np.zeros(len(code), np.uint64), []
    for n in range(1, max(p.orders) + 1):
        h = (h[: len(code) - n + 1] + code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in p.orders:
            found.append((h >> np.uint64(8) & np.uint64((1 << p.bits) - 1)).astype(np.int64))
    features = np.concatenate(found)
    if len(features) < DENSE:
        return np.unique(features, return_counts=True)
    total = np.bincount(features)
    at = np.flatnonzero(total)
    return at, total[at]


_ALPHA = np.zeros(0x110000, bool)


def _letters(code: np.ndarray) -> np.ndarray:
    if not _ALPHA[97]:
        _ALPHA[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _ALPHA[code]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def _frequencies(p: Params) -> Callable:
    """For each partition of texts, how many hold each feature; feature -1: how many texts."""

    def run(batches):
        df, texts = np.zeros(1 << p.bits, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df[grams(t.as_py(), p)[0]] += 1
                texts += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], texts))], names=["feature", "n"])

    return run


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, p: Params) -> np.ndarray:
    """Weights (features + 1, langs) after ``epochs`` passes in the given order."""
    z = np.zeros(((1 << p.bits) + 1, n_langs))
    n = np.zeros_like(z)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= p.l1, 0.0, w)

    for _ in range(p.epochs):
        for at, x, label in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            prob = softmax(x @ w)
            prob[label] -= 1.0
            g = np.outer(x, prob)
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / p.alpha * w
            n[at] = grown
    return weights(z, n)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature from 0.05 to 20 of the least log loss, by golden section."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        return -float(np.log(softmax(logits / math.exp(log_t))[np.arange(len(labels)), labels] + 1e-12).mean())

    a, b, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def example(at: np.ndarray, n: np.ndarray, idf: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Features and values, the last of which is the bias."""
    return np.append(at, 1 << p.bits), np.append(tfidf(at, n, idf), 1.0)


def _features(p: Params) -> Callable:
    """lang, place, features and counts of (lang, place, text)."""

    def run(batches):
        for batch in batches:
            got = [grams(t.as_py(), p) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["lang", "place", "features", "counts"])

    return run


def sampled(rows: DataFrame, p: Params) -> DataFrame:
    """(lang, h, place, text): the examples of ``rows`` (text, lang), the place by h, a hash of the text. A cut on h where
    rows are read passes twice as many texts as are wanted, however many there are."""
    hashed = rows.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    texts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    each = max(10, min(p.per_lang, p.rows // max(len(texts), 1)))
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, 2 * each / n)) for lang, n in sorted(texts.items())], "of string, share double")
    cut = hashed.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(F.col("h") < F.col("share") * (1 << 40))
    once = cut.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    return once.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= each).select("lang", "h", "place", "text")


def fit(rows: DataFrame, p: Params = Params()) -> Model:
    """A model of ``rows`` (text, lang); rows without a lang or a letter in their text teach nothing.
    Without any such row the model knows no language. Examples come in order of their place, then
    their language."""
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counted = rows.select("text").mapInArrow(_frequencies(p), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most 2^bits + 1 rows
    texts = int(found.loc[found["feature"] == -1, "n"].sum())
    df = np.zeros(1 << p.bits)
    own = found[found["feature"] >= 0]
    df[own["feature"].to_numpy(np.int64)] = own["n"].to_numpy()
    idf = np.log((1 + texts) / (1 + df)) + 1
    if not texts:
        return Model((), idf, np.zeros(((1 << p.bits) + 1, 0)), 1.0, p)
    chosen = written(sampled(rows, p), "langid-sample")
    table = chosen.select("lang", "place", "text").mapInArrow(_features(p), "lang string, place bigint, features array<int>, counts array<int>").toPandas()  # a bounded sample
    langs = sorted(set(table["lang"]))
    code = {lang: i for i, lang in enumerate(langs)}
    train, held, gold = [], [], []
    for lang, place, features, counts in sorted(zip(table["lang"], table["place"], table["features"], table["counts"], strict=True), key=lambda x: (x[1], x[0])):
        at, x = example(np.asarray(features, np.int64), np.asarray(counts, np.int64), idf, p)
        if place % 5 == 0:
            held.append((at, x))
            gold.append(code[lang])
        else:
            train.append((at, x, code[lang]))
    w = ftrl(train, len(langs), p)
    logits = np.array([x @ w[at] for at, x in held]).reshape(len(held), len(langs))
    return Model(tuple(langs), idf.astype(np.float32), w.astype(np.float32), temperature(logits, np.array(gold, np.int64)), p)


def predict_one(text: str | None, m: Model) -> tuple[str, float]:
    if not m.langs or not has_letter(text):
        return UNDETERMINED, 0.0
    at, x = example(*grams(text, m.params), m.idf, m.params)
    prob = softmax((x @ m.weights[at]) / m.temperature)
    k = int(prob.argmax())
    return m.langs[k], float(prob[k])


def predict(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, lang_pred and score (the calibrated probability) for each row of ``docs``
    (doc_id, text). Null texts, and texts without a letter, are ``und`` with score 0, as is
    everything where the model knows no language."""

    def run(batches):
        for batch in batches:
            got = [predict_one(t.as_py(), m) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out() -> object:
    """The third of the rows that must not be learned from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
