"""Substring deduplication by seed and extend.

Seeds: of the k-gram hashes in each window of ``length`` words, the leftmost smallest is the
window's anchor (winnowing), so equal windows have equal anchors, and about two windows in
``length - k + 2`` have an anchor of their own. A seed's stretch is extended both ways as
far as it stays the anchor: the windows lo..hi, with all their words.

Stretches are joined on their anchors. Equal stretches are one class, known by its first
place, and every other member repeats it whole. Where an anchor has several classes, which
agree in part, the windows of each class's first place are compared one by one. Windows that
also start earlier merge into maximal repeats, which are removed.

No group is paired with itself, however large: classes are made by partial aggregation, and a
window looks up only the first place of its kind. Spans count as equal if two independent
64-bit hashes, of the anchor and of the whole span, are equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import written
from millrace.llm.words import Spans, WordHashes, sliced, sliding_minimum

LENGTH = 20
KGRAM = 6
#: Numbers, of at most 8 bytes, up to which a table of spans is broadcast.
BROADCAST_NUMBERS = 2_000_000


def stretches(hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, span hash, lo, hi) of a document's stretches; None if it is too short."""
    n = len(hashes) - length + 1
    if n < 1:
        return None
    spans = Spans(hashes)
    starts = np.arange(len(hashes) - k + 1)
    grams = spans.hash(starts, starts + k)
    anchor = sliding_minimum(grams, length - k + 1)
    lo = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    hi = np.append(lo[1:], n) - 1
    place = anchor[lo]
    # The anchor's place within the stretch belongs to what equal stretches agree in.
    span = spans.hash(lo, hi + length) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return grams[place], span, lo, hi


def _seeds(length: int, k: int) -> Callable:
    names = ["doc_id", "version", "anchor", "span", "lo", "hi"]

    def run(batches):
        known = WordHashes()
        for batch in sliced(batches):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            ids, versions, null = [], [], []
            for doc_id, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = stretches(known.of((text.as_py() or "").encode("utf-8", "surrogatepass").split()), length, k)
                if found is not None:
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
                    ids.append(np.full(len(found[0]), 0 if doc_id is None else doc_id, np.int64))
                    versions.append(np.full(len(found[0]), version, np.int64))
                    null.append(np.full(len(found[0]), doc_id is None))
            if ids:
                anchor, span, lo, hi = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), mask=np.concatenate(null)), pa.array(np.concatenate(versions)), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id as a long and version: 0 unless rows of that doc_id repeat, then
    xxhash64 of the text, as their texts may differ. (A hash in every row would be the larger
    part of what is shuffled.)"""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"), F.lit(True).alias("__repeats")), "substring-ids")
    if again.isEmpty():
        return docs.withColumn("version", F.lit(0).cast("bigint"))
    marked = docs.join(again, F.col("doc_id").eqNullSafe(F.col("__again")), "left")
    return marked.withColumn("version", F.when(F.col("__repeats"), F.xxhash64("text")).otherwise(F.lit(0))).drop("__again", "__repeats")


def seeds(docs: DataFrame, length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """(doc_id, version, anchor, span, lo, hi) of the stretches of ``docs`` (doc_id, version, text)."""
    return docs.select("doc_id", "version", "text").mapInArrow(_seeds(length, k), "doc_id bigint, version bigint, anchor bigint, span bigint, lo int, hi int")


def _windows(length: int) -> Callable:
    """Windows of the listed stretches of a text."""
    names = ["doc_id", "version", "anchor", "window", "at"]

    def run(batches):
        known = WordHashes()
        for batch in sliced(batches):
            for row in batch.to_pylist():
                spans = Spans(known.of(row["text"].encode("utf-8", "surrogatepass").split()))
                at = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(row["los"], row["his"], strict=True)])
                anchor = np.repeat(np.array(row["anchors"], np.int64), np.array(row["his"]) - np.array(row["los"]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * len(at), pa.int64()), pa.array([row["version"]] * len(at), pa.int64()), pa.array(anchor), pa.array(spans.hash(at, at + length).view(np.int64)), pa.array(at.astype(np.int32))], names=names)

    return run


def _merged(length: int) -> Callable:
    """Maximal runs of words from runs of windows (lo, hi)."""

    def run(batches):
        for batch in batches:
            starts, ends = [], []
            for runs in batch.column(2):
                a, b = [], []
                for r in sorted((x["lo"], x["hi"]) for x in runs.as_py()):
                    if b and r[0] <= b[-1]:
                        b[-1] = max(b[-1], r[1] + length)
                    else:
                        a.append(r[0])
                        b.append(r[1] + length)
                starts.append(a)
                ends.append(b)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(ends, kind)], names=["doc_id", "version", "starts", "ends"])

    return run


def _bounded(lists: DataFrame) -> DataFrame:
    """A written table of lists, marked for broadcast if it has at most BROADCAST_NUMBERS
    numbers, else as it is."""
    held = sum((F.size(c) for c, kind in lists.dtypes if kind.startswith("array")), F.lit(8))
    total = lists.agg(F.coalesce(F.sum(held), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(lists) if total <= BROADCAST_NUMBERS else lists


def _place(start: str) -> Column:
    """What orders occurrences, and then the version, which doesn't."""
    return F.struct(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(start).alias("start")).alias("at"), "version")


def repeats(docs: DataFrame, length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """doc_id, version, starts and ends: the maximal runs of words of ``docs`` (doc_id, version,
    text), from start to before end, covered by windows of ``length`` words that also start earlier.
    Earlier: a smaller (doc_id, start); a null doc_id is larger than any. Rows of equal doc_id
    count as one document, so a repeated row doesn't repeat itself. Documents without such a
    run are not listed; a null text, or one of fewer words, has none."""
    stretch = written(seeds(docs, length, k), "substring-seeds")
    # Anchors found once have no equal elsewhere.
    # (Here and below, a written table on each side lets Spark split a hot anchor's join.)
    again = written(stretch.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "substring-again")
    candidates = written(stretch.join(again, "anchor").select("anchor", "span", _place("lo").alias("place"), (F.col("hi") - F.col("lo")).alias("more")), "substring-candidates")
    classes = candidates.groupBy("anchor", "span", "more").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    classes = written(classes, "substring-classes")
    # All members of a class but the first repeat the first, window by window.
    several = classes.where("n > 1").select("anchor", "span", "more", F.col("first.at").alias("first"))
    later = candidates.join(several, ["anchor", "span", "more"]).where("place.at > first")
    lo = F.col("place.at.start")
    whole = later.select("place.at.doc_id", "place.version", lo.alias("lo"), (lo + F.col("more")).alias("hi"))
    # Classes that share an anchor may share some of their windows.
    shared = written(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1").select("anchor"), "substring-shared")
    lo = F.col("first.at.start")
    heads = classes.join(shared, "anchor").select("first.at.doc_id", "first.version", F.struct("anchor", lo.alias("lo"), (lo + F.col("more")).alias("hi")).alias("found"))
    by_doc = heads.groupBy("doc_id", "version").agg(F.collect_list("found").alias("found"))
    by_doc = written(by_doc.select("doc_id", "version", F.col("found.anchor").alias("anchors"), F.col("found.lo").alias("los"), F.col("found.hi").alias("his")), "substring-heads")
    # About half of all documents have such a class, so this join shuffles the texts.
    texts = docs.select("doc_id", "version", "text").join(by_doc.withColumnsRenamed({"doc_id": "id", "version": "of"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("of")))
    windows = texts.select("doc_id", "version", "text", "anchors", "los", "his").mapInArrow(_windows(length), "doc_id bigint, version bigint, anchor bigint, window bigint, at int")
    windows = written(windows.select("anchor", "window", _place("at").alias("place")), "substring-windows")
    first = windows.groupBy("anchor", "window").agg(F.min("place.at").alias("first"), F.max("place.at").alias("last")).where("first < last").drop("last")
    first = written(first, "substring-first")
    start = F.col("place.at.start")
    partly = windows.join(first, ["anchor", "window"]).where("place.at > first").select("place.at.doc_id", "place.version", start.alias("lo"), start.alias("hi"))
    found = whole.union(partly).groupBy("doc_id", "version").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    return found.mapInArrow(_merged(length), "doc_id bigint, version bigint, starts array<int>, ends array<int>")


def _removed(batches):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    for batch in sliced(batches):
        out = []
        for text, starts, ends in zip(*(batch.column(i) for i in range(3)), strict=True):
            text, spans = text.as_py(), list(zip(starts.as_py() or [], ends.as_py() or [], strict=True))
            raw = (text or "").encode("utf-8", "surrogatepass")
            words = raw.split()
            if not spans:
                out.append((len(words), 0, b" ".join(words), text))
                continue
            places = [m.span() for m in word.finditer(raw)]
            kept, left, w, at = [], [], 0, 0
            for a, b in spans:
                kept += words[w:a]
                left.append(raw[at : places[a][0]])
                w, at = b, places[b][0] if b < len(places) else len(raw)
            kept += words[w:]
            left.append(raw[at:])
            out.append((len(words), len(words) - len(kept), b" ".join(kept), b"".join(left).decode("utf-8", "surrogatepass")))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], names=[*batch.schema.names[3:], "n_words", "n_removed", "kept", "left"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """The columns of ``docs`` but text as a struct ``doc``, and n_words, n_removed, kept (UTF-8 of the
    kept words joined by spaces; empty for a null text) and left (the text without the
    removed words; unchanged, null included, where none is), a row for each row of ``docs``."""
    others = [c for c in docs.columns if c != "text"]
    renamed = [F.col(c).alias(f"__c{i}") for i, c in enumerate(others)]
    d = _keyed(docs.select("doc_id", "text", *renamed))
    found = _bounded(written(repeats(d, length, k), "substring-spans")).withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version"))
    rest = [f"__c{i}" for i in range(len(others))]
    schema = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in rest)
    out = d.join(found, same, "left").select("text", "starts", "ends", *rest).mapInArrow(_removed, f"{schema}, n_words bigint, n_removed bigint, kept binary, left string")
    return out.select(F.struct(*[F.col(c).alias(name) for c, name in zip(rest, others, strict=True)]).alias("doc"), "n_words", "n_removed", "kept", "left")
