"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the k-gram hashes in each window of ``WINDOW`` words the leftmost smallest is kept, on both
sides; equal windows keep equal hashes at equal places, so every shared window has a fingerprint in
common. (An item of fewer words is one window; it is fingerprinted by its only k-gram of all its
words, and documents by all theirs of that length, for each such length that the benchmark has.)

First the documents' fingerprints, without places, are joined with the benchmark's, which leaves
the candidates. In these, each place of a gram with a benchmark fingerprint's hash is a seed: the
words around it are compared with the item's, both ways as far as a window with the seed can reach,
and the longest common run about the seed, if at least a window long, is a hit. A longer shared span
is the union of the hits of its windows' seeds. Items with the same words about a fingerprint are
one context, so a passage of many items is compared once.

Tables are broadcast if their counted rows and bytes are within bounds, and joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import let
from millrace.llm.store import bounded, written

WINDOW = 13
KGRAM = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does just that where all characters are of one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(wh: Column, k: int) -> Column:
    """Hashes of the k-grams of an array of word hashes; empty if it is shorter."""
    return F.when(F.size(wh) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(wh) - (k - 1)), lambda i: F.xxhash64(F.slice(wh, i, k))))


def _minima(h: Column, span: int) -> Column:
    """The smallest hash of each ``span`` consecutive ones."""
    return F.when(F.size(h) < span, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda i: F.array_min(F.slice(h, i, span))))


def fingerprints(wh: Column, short: list[int], window: int = WINDOW, k: int = KGRAM) -> Column:
    """(length, hash) of a document's word hashes: the winnowed ones (length ``window``), and all grams of the
    short lengths."""
    winnowed = F.array_distinct(let(grams(wh, k), lambda h: _minima(h, window - k + 1)))
    return F.concat(_tagged(winnowed, window), *[_tagged(F.array_distinct(grams(wh, n)), n) for n in short])


def _tagged(hashes: Column, length: int) -> Column:
    return F.transform(hashes, lambda x: F.struct(F.lit(length).alias("length"), x.alias("hash")))


def _around(w: Column, hash_: Column, at: Column, length: int, k: int, window: int) -> Column:
    """What is compared about the gram at place ``at``: the words before it, nearest first, and
    from it on, as far as a window that holds the gram can reach."""
    reach = window - k if length == window else 0
    before = F.reverse(F.slice(w, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach))))
    return F.struct(F.lit(length).alias("length"), hash_.alias("hash"), at.alias("at"), before.alias("before"), F.slice(w, at, k + reach).alias("after"))


def benchmark_seeds(benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """(item_id, context, length, hash, at, before, after): each item's fingerprints with the words about
    them, and a hash of these. A null id is the empty one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    span = window - k + 1

    def places(w: Column) -> Column:
        at = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (span - 1)), lambda i: let(F.slice(h, i, span), lambda s: (i + F.array_position(s, F.array_min(s)) - 1).cast("int"))))
        return let(let(hashes(w), lambda wh: grams(wh, k)), lambda h: F.transform(at(h), lambda p: _around(w, F.get(h, p - 1), p, window, k, window)))

    w = F.col("words")
    short = F.array(F.struct(F.size(w).alias("length"), F.xxhash64(hashes(w)).alias("hash"), F.lit(1).alias("at"), F.slice(w, 1, 0).alias("before"), w.alias("after")))
    seeds = items.select("item_id", F.inline(F.when(F.size(w) >= window, let(w, places)).otherwise(short)))
    return seeds.withColumn("context", F.xxhash64("length", "hash", F.size("before"), "before", "after"))


def _common(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays agree."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    return F.when(first == 0, n).otherwise((first - 1).cast("int"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """(doc_id, version, spans, items) of the documents that hold a window of an item: spans are
    the maximal runs (start, end) of hit words, from start (from 1) to before end, in order; items
    the sorted distinct ids. version is xxhash64 of the text: rows equal in both have one line."""
    seeds = written(benchmark_seeds(benchmark, window, k), "benchmark-seeds")
    prints = written(seeds.select("length", "hash").distinct(), "benchmark-prints")
    short = sorted(r["length"] for r in prints.select("length").distinct().collect() if r["length"] < window)  # at most window - 1 lengths
    key = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    found = key.select("doc_id", "version", F.inline(let(hashes(words(F.col("text"))), lambda wh: fingerprints(wh, short, window, k))))
    candidates = written(found.join(bounded(prints), ["length", "hash"]).select("doc_id", "version").distinct(), "benchmark-candidates")
    same = F.expr("d.doc_id <=> c.doc_id AND d.version = c.version")
    texts = written(key.alias("d").join(bounded(candidates).alias("c"), same, "left_semi").groupBy("doc_id", "version").agg(F.min("text").alias("text")), "benchmark-texts")

    def tagged(w: Column) -> Column:
        """The grams of a document, of each length, with their places."""
        of = lambda wh, length, n: F.transform(grams(wh, n), lambda h, i: F.struct(F.lit(length).alias("length"), h.alias("hash"), (i + 1).alias("at")))
        return let(hashes(w), lambda wh: F.concat(of(wh, window, k), *[of(wh, n, n) for n in short]))

    seeded = texts.select("doc_id", "version", F.inline(tagged(words(F.col("text"))))).join(bounded(prints), ["length", "hash"])
    # At most a document's own words times the lengths in a row.
    seeded = written(seeded.groupBy("doc_id", "version").agg(F.collect_list(F.struct("length", "hash", "at")).alias("places")), "benchmark-places")

    def around(w: Column) -> Column:
        about = lambda x: F.when(x["length"] == window, _around(w, x["hash"], x["at"], window, k, window))
        for_short = lambda x: F.struct(x["length"].alias("length"), x["hash"].alias("hash"), x["at"].alias("at"), F.slice(w, 1, 0).alias("before"), F.slice(w, x["at"], x["length"]).alias("after"))
        return F.transform("places", lambda x: F.coalesce(about(x), for_short(x)))

    own = texts.alias("d").join(bounded(seeded).alias("c"), same).select("d.doc_id", "d.version", F.inline(let(words(F.col("d.text")), around)))
    contexts = written(seeds.select("context", "length", "hash", F.col("before").alias("item_before"), F.col("after").alias("item_after")).distinct(), "benchmark-contexts")
    agree = own.join(bounded(contexts), ["length", "hash"]).select("doc_id", "version", "context", "length", "at", _common(F.col("before"), F.col("item_before")).alias("left"), _common(F.col("after"), F.col("item_after")).alias("right"))
    extended = written(agree.where("left + right >= length").select("doc_id", "version", "context", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")), "benchmark-matches")
    members = written(seeds.select("context", "item_id").distinct(), "benchmark-members")
    items = extended.select("doc_id", "version", "context").distinct().join(bounded(members), "context").groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    # Runs that touch or overlap are one; a document's own runs are all that a window holds.
    in_doc = Window.partitionBy("doc_id", "version").orderBy("start", "end")
    runs = extended.select("doc_id", "version", "start", "end").distinct()
    runs = runs.withColumn("reach", F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("island", F.count_if(F.coalesce(F.col("start") > F.col("reach"), F.lit(True))).over(in_doc))
    spans = runs.groupBy("doc_id", "version", "island").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span"))
    spans = spans.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    same = F.expr("s.doc_id <=> i.doc_id AND s.version = i.version")  # each has a row for each of these documents
    return spans.alias("s").join(items.alias("i"), same).select("s.doc_id", "s.version", "spans", "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """The columns of ``docs`` as a struct ``doc``, and n_words, n_hit, items (ids of the items with
    occurring windows), spans and contaminated (a hit, and at least a twentieth of the words), a
    row for each row of ``docs`` (doc_id, text). A null text has no words. Null item texts, and those
    without words, have no window; rows of one item_id count as one item, and null ids as the empty one."""
    found = bounded(written(hits(docs, benchmark, window, k), "benchmark-hits")).alias("h")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("of"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORDS)).cast("bigint").alias("n_words"))
    joined = d.join(found, F.expr("id <=> h.doc_id AND of = h.version"), "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"])), F.lit(0).cast("bigint"))
    out = joined.select("doc", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def without(text: Column, spans: Column) -> Column:
    """A text without the words of the spans; what stands between words stays."""

    def build(gaps: Column) -> Column:
        def rebuilt(w: Column) -> Column:
            joined = lambda a, n: F.array_join(F.zip_with(F.slice(gaps, a, n), F.slice(w, a, n), lambda g, x: F.concat(g, x)), "")
            # The words between the span before and this one, then this one's gaps.
            left = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get(spans, i - 1)["end"])
            pieces = F.transform(spans, lambda s, i: F.concat(joined(left(i), s["start"] - left(i)), F.array_join(F.slice(gaps, s["start"], s["end"] - s["start"]), "")))
            last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(1))
            return F.concat(F.array_join(pieces, ""), joined(last, F.size(w) + 1 - last), F.element_at(gaps, -1))

        return let(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), rebuilt)

    return let(F.split(text, WORDS), build)


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, and without the hit words in the others."""
    out = contaminated(docs, benchmark).where("NOT contaminated")
    text = F.when(F.col("n_hit") > 0, without(F.col("doc.text"), F.col("spans"))).otherwise(F.col("doc.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
