"""Language-model scores by stupid backoff over bigrams, computed relationally.

    S(v | u) = c(u v) / c(u)        if c(u v) >= MIN_COUNT
             = ALPHA * c(v) / N      otherwise

A document's score is the sum of ln S over its words; the first follows a start mark, whose count is
that of the documents with words. The bigram table is pruned below ``MIN_COUNT``: the corpus scores
itself, so a bigram found once says nothing about the model. All counts are over the whole corpus.

Documents are exploded into (bigram, document, times) rows, dealt out by hash once. In each hash
partition the count table is a ``groupBy`` of these rows, joined back to them, and the joined scores
are summed by document. One exchange is enough because of how a bigram is keyed. Words of a bounded
dictionary (the most frequent of a bounded sample; their counts are exact and broadcast) have small
codes, other words 64-bit hashes:

    kind  words                key k     other o        scored there
    P     both in dictionary   bigram    0              everything
    V     v not                v         u              all but the share of a u that isn't either
    U     u not, v in it       u         v              everything
    X     neither, once more   u         v              the share of u, if the bigram was found

The count of a word outside the dictionary is that of the V rows of its key, so it is at hand in
the partition of the word. The dictionary, and which bigrams are hot, decide only how rows are dealt
out, never a score. Bigrams that are hot in the sample are counted exactly, then scored where they
are read; so a bigram of a third of all documents doesn't pile up in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import setting, width, written
from millrace.llm.words import mix

ALPHA = 0.4
MIN_COUNT = 2
#: Documents of the sample, and the most words and bigrams that are taken from it.
SAMPLE, WORDS, HOT = 2_000, 100_000, 5_000
#: Times that a word of the dictionary, or a hot bigram, is found in the sample.
WORD_TIMES, HOT_TIMES = 3, 20
#: Tokens, and documents, that a task explodes at a time.
FLUSH_TOKENS, FLUSH_DOCS = 400_000, 60_000
START = 0  # the start mark's code; other codes of the dictionary are 1 to WORDS
#: Bits of a dictionary code, and what marks U rows, attribute rows and X rows.
CODE, OTHER, ATTRIBUTE, TWICE = 20, 1 << 40, 1 << 41, 1 << 62
#: Bits beside the row number for the times of a bigram, or for an attribute's tag.
TIMES = 8
BASE, ID, LENGTH = 1, 2, 3
UNITS = 1_000_000_000  # of a base score


class Codes(dict):
    """Codes of words, remembered up to a bound: a dictionary word's number, or a negative hash."""

    bound = 150_000

    def __init__(self, dictionary: np.ndarray) -> None:
        super().__init__()
        self.number = {h: i + 1 for i, h in enumerate(dictionary.tolist())}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = (xxhash.xxh3_64_intdigest(word) | 1 << 63) - (1 << 64)
        code = self[word] = self.number.get(h, h)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _flushes(batches, columns: int, dictionary: np.ndarray) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(the other columns' values, word codes) of documents, some at a time."""
    known = Codes(dictionary)
    rows: list = []
    words: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for *own, text in zip(*(batch.column(i) for i in range(columns)), strict=True):
            words.append(known.of((text.as_py() or "").encode("utf-8", "surrogatepass").split()))
            rows.append([x.as_py() for x in own])
            held += len(words[-1])
            if held >= FLUSH_TOKENS or len(rows) >= FLUSH_DOCS:
                yield rows, words
                rows, words, held = [], [], 0
    if rows:
        yield rows, words


def _bigrams(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, second words and document numbers."""
    lengths = np.array([len(w) for w in words], np.int64)
    v = np.concatenate([*words, np.zeros(0, np.int64)])
    u = np.concatenate(([START], v[:-1])) if len(v) else v
    u[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return u, v, np.repeat(np.arange(len(words)), lengths)


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The key of a bigram of the dictionary."""
    return (u << CODE) | v


def _sampled(batches):
    """(pair, u, v, n) of the sample: its words (u, hashes), and bigrams (u, v)."""
    none = np.zeros(0, np.int64)
    for _, words in _flushes(batches, 1, none):
        u, v, _ = _bigrams(words)
        keys, n = np.unique(v, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), bool)), pa.array(keys), pa.array(np.zeros(len(keys), np.int64)), pa.array(n)], names=["pair", "u", "v", "n"])
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), pa.array(u[at]), pa.array(v[at]), pa.array(np.diff(np.append(at, len(u))))], names=["pair", "u", "v", "n"])


def sampled(text: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the dictionary's words, keys of the hot bigrams), at most WORDS and HOT."""
    share = min(1.0, SAMPLE / max(text.count(), 1))
    some = text.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = some.mapInArrow(_sampled, "pair boolean, u bigint, v bigint, n bigint").groupBy("pair", "u", "v").agg(F.sum("n").alias("n"))
    top = lambda of, times, most: found.where(of & (F.col("n") >= times)).orderBy(F.desc("n"), "u", "v").limit(most).select("u", "v").toPandas()
    words = top(~F.col("pair"), WORD_TIMES, WORDS)["u"].to_numpy(np.int64)
    pairs = top(F.col("pair"), HOT_TIMES, HOT)
    number = {START: START} | {h: i + 1 for i, h in enumerate(words.tolist())}
    hot = [_pair(number[u], number[v]) for u, v in zip(pairs["u"].tolist(), pairs["v"].tolist(), strict=True) if u in number and v in number]
    return words, np.sort(np.array(hot, np.int64))


def _places(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is in the sorted table, its place)."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _counted(dictionary: np.ndarray, hot: np.ndarray) -> Callable:
    """For each partition, (code, n): code c >= 0 is a word's, and START's the documents with words;
    -1 all words; -2 - i the i-th hot bigram."""

    def run(batches):
        own, pairs, total = np.zeros(len(dictionary) + 1, np.int64), np.zeros(len(hot), np.int64), 0
        for _, words in _flushes(batches, 1, dictionary):
            u, v, _ = _bigrams(words)
            own += np.bincount(v[v > 0], minlength=len(own))
            own[START] += sum(len(w) > 0 for w in words)
            total += len(v)
            both = (u >= 0) & (v >= 0)
            there, at = _places(hot, _pair(u[both], v[both]))
            pairs += np.bincount(at[there], minlength=len(pairs))[: len(pairs)]
        code = np.concatenate((np.arange(len(own)), [-1], -2 - np.arange(len(pairs))))
        n = np.concatenate((own, [total], pairs))
        yield pa.RecordBatch.from_arrays([pa.array(code[n > 0]), pa.array(n[n > 0])], names=["code", "n"])

    return run


def _exploded(dictionary: np.ndarray, counts: np.ndarray, hot: np.ndarray, times: np.ndarray, total: int) -> Callable:
    """(k, o, w) rows of (row, doc_id, text): w is the row number with the bigram's times."""

    def run(batches):
        for rows, words in _flushes(batches, 3, dictionary):
            u, v, d = _bigrams(words)
            # One row for each bigram of a document; two under one 48-bit key would only stay apart.
            key = (d.astype(np.uint64) << np.uint64(48)) | (mix(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64)) >> np.uint64(16))
            order = np.argsort(key)
            u, v, d = u[order], v[order], d[order]
            new = np.ones(len(d), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1])
            at = np.flatnonzero(new)
            u, v, d, n = u[at], v[at], d[at], np.diff(np.append(at, len(d)))
            there, place = _places(hot, np.where((u >= 0) & (v >= 0), _pair(np.maximum(u, 0), np.maximum(v, 0)), -1))
            c = times[place[there]]
            s = np.where(c >= MIN_COUNT, np.log(np.maximum(c, 1)) - np.log(counts[u[there]]), np.log(ALPHA / total * counts[v[there]]))
            base = np.bincount(d[there], n[there] * s, len(rows))
            u, v, d, n = u[~there], v[~there], d[~there], n[~there]
            most = (1 << TIMES) - 1
            if len(n) and n.max() > most:
                parts = -(-n // most)
                last = np.cumsum(parts) - 1
                left = n - (parts - 1) * most
                u, v, d, n = np.repeat(u, parts), np.repeat(v, parts), np.repeat(d, parts), np.full(parts.sum(), most)
                n[last] = left
            row = np.array([r[0] for r in rows], np.int64) << TIMES
            rare_u, rare_v = u < 0, v < 0
            w = row[d] | n
            twice = rare_u & rare_v
            k = np.where(rare_v, v, np.where(rare_u, u, _pair(u, v)))
            o = np.where(rare_v, u, np.where(rare_u, OTHER + v, 0))
            ids = np.array([r[1] is not None for r in rows])
            value = np.array([r[1] or 0 for r in rows], np.int64)
            length = np.array([len(x) for x in words], np.int64)
            home = ATTRIBUTE + (row >> TIMES)
            columns = (
                (k, u[twice], home, home[ids], home),
                (o, TWICE | (v[twice] & (TWICE - 1)), np.rint(base * UNITS).astype(np.int64), value[ids], length),
                (w, w[twice], row | BASE, row[ids] | ID, row | LENGTH),
            )
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["k", "o", "w"])

    return run


def _scored(table: DataFrame, counts: np.ndarray, total: int) -> DataFrame:
    """(k, o, s): what one time of a key's bigram adds to a score, of ``table`` (k, o, c: times, own: the
    key's word's). Of the dictionary's counts a bigram needs its first word's if it was found, else
    its second's."""
    spark, found = table.sparkSession, f"c >= {MIN_COUNT}"
    unigrams = [(i, float(np.log(n)) if n else None) for i, n in enumerate(counts.tolist())]
    unigrams = F.broadcast(spark.createDataFrame(unigrams, "code bigint, log_n double"))  # WORDS + 1 rows at most
    code = F.expr(f"""CASE WHEN k >= {ATTRIBUTE} OR o >= {TWICE} THEN NULL
        WHEN k >= 0 THEN CASE WHEN {found} THEN shiftright(k, {CODE}) ELSE k & {(1 << CODE) - 1} END
        WHEN o >= {OTHER} THEN CASE WHEN {found} THEN NULL ELSE o - {OTHER} END
        WHEN o >= 0 AND {found} THEN o END""")
    back = float(np.log(ALPHA / total))
    score = F.expr(f"""CASE WHEN k >= {ATTRIBUTE} THEN 0D
        WHEN k >= 0 THEN CASE WHEN {found} THEN ln(c) - log_n ELSE {back!r}D + log_n END
        WHEN o >= {TWICE} THEN CASE WHEN {found} THEN -ln(own) ELSE 0D END
        WHEN o >= {OTHER} THEN CASE WHEN {found} THEN ln(c) - ln(own) ELSE {back!r}D + log_n END
        WHEN {found} THEN ln(c) - coalesce(log_n, 0D) ELSE {back!r}D + ln(own) END""")
    return table.withColumn("code", code).join(unigrams, "code", "left").select("k", "o", score.alias("s"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and log_score of each row of ``docs`` (doc_id, text), which are also the
    corpus. Words are the runs between ASCII white space, as they are. A null text, or one without
    words, has n_words and log_score 0; every row counts in the corpus, repeated ones as often. Words
    are known by 63-bit hashes."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary, hot = sampled(text)
    counted = text.select("text").mapInArrow(_counted(dictionary, hot), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    found = {r["code"]: r["n"] for r in counted.collect()}  # at most WORDS + HOT + 2
    total = max(found.get(-1, 0), 1)
    counts = np.array([found.get(i, 0) for i in range(len(dictionary) + 1)], np.int64)
    times = np.array([found.get(-2 - i, 0) for i in range(len(hot))], np.int64)
    # Row numbers stand for documents, whose ids may be null or repeat.
    rows = text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # Both sides of the join read this exchange: w holds all that either needs, so it is one and the same.
    dealt = rows.mapInArrow(_exploded(dictionary, counts, hot, times, total), "k bigint not null, o bigint not null, w bigint not null").repartition(width(spark), "k")
    table = dealt.groupBy("k", "o").agg(F.sum(F.col("w").bitwiseAND(F.lit((1 << TIMES) - 1))).alias("c"))
    key = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumn("own", F.sum(F.when(F.col("o") < OTHER, F.col("c"))).over(key))
    joined = dealt.join(_scored(table, counts, total), ["k", "o"])
    low = F.col("w").bitwiseAND(F.lit((1 << TIMES) - 1))
    tag = F.when(F.col("k") >= ATTRIBUTE, low)
    adds = F.when(F.col("k") < ATTRIBUTE, low * F.col("s")).when(tag == BASE, F.col("o") / UNITS).otherwise(0.0)
    scored = joined.select(F.expr(f"shiftright(w, {TIMES})").alias("row"), F.when(tag == ID, F.col("o")).alias("doc_id"), F.when(tag == LENGTH, F.col("o")).alias("n_words"), adds.alias("s"))
    by_row = scored.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("s").alias("log_score"))
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # partitions of k serve the join by k and o
        return written(by_row, "backoff-scores").select("doc_id", "n_words", "log_score")


#: The query in DuckDB SQL, scores rounded to three places.
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT rid, i, ws[i] AS v, CASE WHEN i > 1 THEN ws[i - 1] END AS u FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
uni AS (SELECT v, count(*) AS c FROM t GROUP BY v), pre AS (SELECT v AS u, c FROM uni UNION ALL SELECT NULL, count(*) FROM d WHERE len(ws) > 0), bi AS (SELECT u, v, count(*) AS c FROM t GROUP BY u, v),
s AS (SELECT rid, sum(CASE WHEN bi.c >= {MIN_COUNT} THEN ln(bi.c) - ln(pre.c) ELSE ln(uni.c * ({ALPHA} / (SELECT count(*) FROM t))) END) AS log_score
  FROM t JOIN bi ON t.u IS NOT DISTINCT FROM bi.u AND t.v = bi.v JOIN pre ON t.u IS NOT DISTINCT FROM pre.u JOIN uni ON t.v = uni.v GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(log_score, 0.0), 3) AS log_score, round(coalesce(log_score / len(ws), 0.0), 4) AS score FROM d LEFT JOIN s USING (rid)"""
