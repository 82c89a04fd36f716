"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame operations only.

A sketch is a log-linear histogram of an integer metric: values below 1024 have a bucket each,
larger ones share buckets of a 512th of their magnitude, so a quantile is off by 0.2 % at most. It
merges by adding counts, which makes it a plain grouped count: combined before the shuffle, and
the same however the rows are dealt out. There is one for each metric, language and source; those
of a language's sources merge into the language's, and these into the corpus's. A group of fewer
than ``MIN_GROUP`` documents takes its thresholds from its language, or else from the corpus.

Tukey's fences on the quartiles replace fixed cutoffs: a document is rejected if a metric is
above Q3 + 3 (Q3 - Q1) + slack or, for the word length, below Q1 - 3 (Q3 - Q1) - slack of its
group. The slack keeps documents of groups that hardly vary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import let
from millrace.llm.store import bounded, without_rows, written

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MIN_GROUP = 30
#: Metric: slack, and whether low values are rejected as well. Shares are in thousandths, the
#: word length in hundredths of a character; the lines' share is of ten lines more, so that a
#: heading found twice in a short text does not weigh like a text of repeated lines.
METRICS = {"symbols": (50, False), "dup_lines": (200, False), "capitals": (100, False), "word_length": (150, True)}
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more in the text. Windows
    are compared by 64-bit hashes; equal ones stand together once sorted."""

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))

    def places(s: Column) -> Column:
        same = lambda j: F.coalesce(F.get(s, j)["h"], F.lit(None))
        twice = F.filter(s, lambda x, j: F.coalesce(same(j - 1) == x["h"], F.lit(False)) | F.coalesce(same(j + 1) == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def covered(ps: Column) -> Column:
        new = F.transform(ps, lambda p, j: F.least(F.coalesce(F.get(ps, j + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x)

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(let(windows, places), covered))


def _counts(text: Column) -> Column:
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated(w).alias("r"))).alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("l"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, version (xxhash64 of the text), lang, source, the counts in FIELDS, base_failed and the metrics, a row for each row
    of ``docs`` (doc_id, text, lang, source). A null text has no words; a metric without words is
    null."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("version"), _counts(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("c"))
    d = d.select("doc_id", "version", "lang", "source", F.col("c.w.n").alias("n_words"), "c.word_chars", "c.n_symbols", F.col("c.l.dup").alias("n_dup_lines"), F.col("c.w.r").alias("n_repeat_words"), F.col("c.n_capitals").alias("n_capitals"), F.col("c.l.n").alias("n_lines"))
    return d.select(
        "doc_id", "version", "lang", "source", *FIELDS,
        F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        F.expr("CASE WHEN n_words > 0 THEN 1000 * n_symbols div word_chars END").alias("symbols"),
        F.expr("CASE WHEN n_words > 0 THEN 1000 * n_dup_lines div (n_lines + 10) END").alias("dup_lines"),
        F.expr("CASE WHEN n_words > 0 THEN 1000 * n_capitals div word_chars END").alias("capitals"),
        F.expr("CASE WHEN n_words > 0 THEN 100 * word_chars div n_words END").alias("word_length"),
    )


def bucket(value: Column) -> Column:
    """The smallest value of a value's bucket."""
    drop = F.greatest(F.length(F.bin(value)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bucket, n): the sketch of each metric in each group of ``rows``."""
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])
    return rows.select(*keys, F.inline(metrics)).where("bucket IS NOT NULL").groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, low_<metric>, high_<metric>) from the sketches of groups."""
    by = Window.partitionBy(*keys, "metric")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.select(*keys, "metric", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(by).alias("total"))
    quart = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), F.expr("min(CASE WHEN 4 * upto >= total THEN bucket END)").alias("q1"), F.expr("min(CASE WHEN 4 * upto >= 3 * total THEN bucket END)").alias("q3"))
    out = [F.max("total").alias("rows")]
    for m, (slack, two_sided) in METRICS.items():
        out.append(F.max(F.when(F.col("metric") == m, F.expr(f"q3 + 3 * (q3 - q1) + {slack}"))).alias(f"high_{m}"))
        if two_sided:
            out.append(F.max(F.when(F.col("metric") == m, F.expr(f"q1 - 3 * (q3 - q1) - {slack}"))).alias(f"low_{m}"))
    return quart.groupBy(*keys).agg(*out)


LIMITS = [*(f"high_{m}" for m in METRICS), *(f"low_{m}" for m, (_, two) in METRICS.items() if two)]


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source) and LIMITS: the fences that hold in each group."""
    own = sketches(rows, ["lang", "source"])
    of_lang = own.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    of_all = of_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    a = fences(own, ["lang", "source"]).alias("a")
    b = fences(of_lang, ["lang"]).alias("b")
    c = fences(of_all.withColumn("one", F.lit(1)), ["one"]).alias("c")  # one row
    joined = a.join(b, F.expr("a.lang <=> b.lang"), "left").join(F.broadcast(c), F.lit(True), "left")
    level = lambda x: F.expr(f"CASE WHEN a.rows >= {MIN_GROUP} THEN a.{x} WHEN b.rows >= {MIN_GROUP} THEN b.{x} ELSE c.{x} END").alias(x)
    return joined.select("a.lang", "a.source", *map(level, LIMITS))


def judged(docs: DataFrame) -> DataFrame:
    """The rows of ``measured`` with the fences of their group and kept: false if base_failed or if
    a metric is beyond a fence. The fences are written, so that Spark can split a hot group's rows."""
    rows = written(measured(docs), "quality-rows")
    t = bounded(written(thresholds(rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"}), "quality-thresholds"))
    joined = rows.join(t, F.expr("lang <=> t_lang AND source <=> t_source"), "left")
    beyond = [F.coalesce(F.col(m) > F.col(f"high_{m}"), F.lit(False)) for m in METRICS] + [F.coalesce(F.col(m) < F.col(f"low_{m}"), F.lit(False)) for m, (_, two) in METRICS.items() if two]
    rejected = F.col("base_failed")
    for b in beyond:
        rejected = rejected | b
    return joined.withColumn("kept", ~rejected).drop("t_lang", "t_source")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    return without_rows(docs, judged(docs).where("NOT kept"))


def _oracle() -> str:
    """The query in DuckDB SQL."""
    metric_rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM m WHERE {m} IS NOT NULL" for m in METRICS)
    bits = "greatest(length(bin(v)) - 10, 0)"

    def level(name: str, keys: str) -> str:
        part = ", ".join([k for k in (keys, "metric") if k])
        highs = ", ".join([f"max(CASE WHEN metric = '{m}' THEN q3 + 3 * (q3 - q1) + {s} END) AS high_{m}" for m, (s, _) in METRICS.items()] + [f"max(CASE WHEN metric = '{m}' THEN q1 - 3 * (q3 - q1) - {s} END) AS low_{m}" for m, (s, two) in METRICS.items() if two])
        group = f" GROUP BY {keys}" if keys else ""
        lead = f"{keys}, " if keys else ""
        return f"""{name}_r AS (SELECT {part}, bucket, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS total FROM (SELECT {part}, bucket, count(*) AS n FROM b GROUP BY {part}, bucket)),
{name}_q AS (SELECT {part}, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3 FROM {name}_r GROUP BY {part}),
{name} AS (SELECT {lead}max(total) AS rows_, {highs} FROM {name}_q{group})"""

    pick = lambda x: f"CASE WHEN s.rows_ >= {MIN_GROUP} THEN s.{x} WHEN l.rows_ >= {MIN_GROUP} THEN l.{x} ELSE a.{x} END"
    beyond = " OR ".join([f"coalesce(m.{m} > {pick(f'high_{m}')}, false)" for m in METRICS] + [f"coalesce(m.{m} < {pick(f'low_{m}')}, false)" for m, (_, two) in METRICS.items() if two])
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, x, y, z) > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
c AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words > 0 THEN 1000 * n_symbols // word_chars END AS symbols,
  CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // (n_lines + 10) END AS dup_lines, CASE WHEN n_words > 0 THEN 1000 * n_capitals // word_chars END AS capitals, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_length FROM c),
b AS (SELECT lang, source, metric, (v >> {bits}) << {bits} AS bucket FROM ({metric_rows})),
{level("s", "lang, source")},
{level("l", "lang")},
{level("a", "")}
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {beyond}) AS kept
FROM m LEFT JOIN s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang LEFT JOIN a ON true"""


ORACLE = _oracle()
