import itertools
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import hilbert, queries
from tests.llm.fixtures import empty, hard, hard_rows


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 3), (3, 2)):
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"c{i} int" for i in range(n)))
        got = cells.withColumn("at", hilbert.curve_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("at").collect()
        assert [r["at"] for r in got] == list(range(1 << n * bits))
        for a, b in itertools.pairwise(got):
            assert sum(abs(a[f"c{i}"] - b[f"c{i}"]) for i in range(n)) == 1


def check(rows, got, n):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    sizes = [counts[k] for k in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for k in range(n):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_hard_rows(spark):
    for n in (24, 500):
        check(hard_rows(), hilbert.shards(hard(spark), n).collect(), n)
    assert hilbert.shards(empty(spark), 24).count() == 0


def test_equal_texts_stand_together(spark):
    got = sorted(hilbert.shards(hard(spark), 1).collect(), key=lambda r: r["slot"])
    order = [(r["text_crc32"], r["size"]) for r in got]
    assert len(list(itertools.groupby(order))) == len(set(order))


def test_cells_follow_the_values(spark):
    rows = [(f"v{i:03}", "hot" if i % 3 else None) for i in range(300) for _ in range(1 + (i == 7) * 900)]
    got = hilbert.quantised_names(spark.createDataFrame(rows, "a string, b string").repartition(5), ["a", "b"], 8).collect()
    cells = dict(sorted((r["value"], r["cell"]) for r in got if r["name"] == "a"))
    want, before = {}, 0
    for v, n in sorted(Counter(v for v, _ in rows).items()):
        want[v] = 1 + before * 255 // len(rows)
        before += n
    assert cells == want and [(r["value"], r["cell"]) for r in got if r["name"] == "b"] == [("hot", 1)]
    assert hilbert.quantised_names(spark.createDataFrame([], "a string"), ["a"], 8).count() == 0


def test_shards_prune_in_every_dimension(spark):
    """Shards that a lookup opens by their minima and maxima, against a cut of the rows in any order."""
    rng = random.Random(4)
    rows = [(i, "x" * int(2 ** rng.uniform(3, 12)) + str(i), rng.choice(["de", "en", "en", "en", "es", "fr"]), "s00" if rng.random() < 0.3 else f"s{rng.randrange(20):02}") for i in range(6000)]
    of = {r["doc_id"]: r["shard"] for r in hilbert.shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 24).collect()}
    dims = {i: (lang, source, len(text)) for i, text, lang, source in rows}

    def opened(shard_of, **equal):
        ends = {}
        for i, k in shard_of.items():
            lows, highs = ends.setdefault(k, (list(dims[i]), list(dims[i])))
            for d in range(3):
                lows[d], highs[d] = min(lows[d], dims[i][d]), max(highs[d], dims[i][d])
        return sum(all(lows[d] <= high and highs[d] >= low for d, (low, high) in equal["by"].items()) for lows, highs in ends.values()) / 24

    anyhow = {i: k % 24 for k, i in enumerate(rng.sample(list(of), len(of)))}
    lookups = [({1: ("s07", "s07")}, 0.5), ({0: ("fr", "fr")}, 0.45), ({2: (64, 100)}, 0.6), ({1: ("s12", "s13"), 2: (64, 100)}, 0.35), ({0: ("es", "es"), 1: ("s15", "s15")}, 0.3)]
    for by, most in lookups:
        assert opened(of, by=by) <= most and opened(anyhow, by=by) == 1.0, (by, opened(of, by=by))


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(rows, queries.op1_hilbert_shards(spark, sf).collect(), 24)
