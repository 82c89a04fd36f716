"""Sharding along a Hilbert curve.

Language, source and text length, each in the order of its values, are quantised to ``bits`` bits
each; the rows are sorted by the index of their cell on the curve, and the sorted run is cut into
shards whose row counts differ by one at most (law ``rows``). Neighbouring cells share a shard and
hold neighbouring values, so most files' minima and maxima are narrow in several dimensions and
prune reads on any of them; tests/llm measures how many files a lookup opens.

A group of equal texts is placed by its smallest (lang, source) and sorts together within its
cell, so a group is split only where a cut falls into it; a group larger than a shard must be.

The sort is a range partitioning on unique keys, so a hot source, cell or text is spread
evenly. The place of a row is its place within its partition plus the sizes of the
partitions before it: one small row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import let
from millrace.llm.store import bounded, width, written

LAW = "rows"


def curve_index(coordinates: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve through a cube of 2^bits cells a side.

    Skilling's transposition (AIP Conference Proceedings 707, 2004) in bit operations: the
    axes are turned into the transposed index, whose bits are then interleaved."""
    # Each step reads the axes as one struct, so a step's expressions stay small.
    n = len(coordinates)
    axes = F.array(*[c.cast("int") for c in coordinates])
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(n):
            axes = let(axes, _step(i, q, p, n))
    axes = let(axes, lambda a: _gray(a, n, bits))
    return let(axes, lambda a: _interleave(a, n, bits))


def _step(i: int, q: int, p: int, n: int):
    def step(a: Column) -> Column:
        invert = a[i].bitwiseAND(F.lit(q)) != 0
        swap = a[0].bitwiseXOR(a[i]).bitwiseAND(F.lit(p))
        first = F.when(invert, a[0].bitwiseXOR(F.lit(p))).otherwise(a[0].bitwiseXOR(swap))
        other = F.when(invert, a[i]).otherwise(a[i].bitwiseXOR(swap))
        return F.array(*[first if k == 0 else other if k == i else a[k] for k in range(n)])

    return step


def _gray(a: Column, n: int, bits: int) -> Column:
    out = [a[0]]
    for i in range(1, n):
        out.append(a[i].bitwiseXOR(out[i - 1]))
    t = F.lit(0)
    for level in range(bits - 1, 0, -1):
        t = t.bitwiseXOR(F.when(out[n - 1].bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    return F.array(*[x.bitwiseXOR(t) for x in out])


def _interleave(a: Column, n: int, bits: int) -> Column:
    index = F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(a[i], level).bitwiseAND(F.lit(1)).cast("bigint")
            index = index.bitwiseOR(F.shiftleft(bit, level * n + n - 1 - i))
    return index


def quantised_names(rows: DataFrame, names: list[str], bits: int) -> DataFrame:
    """(name, value, cell) of the string columns ``names``: cells are in the order of the values and
    hold about equally many rows each, as far as a value's rows allow; 0 is left to null. The
    distinct values are range-partitioned, so there may be any number of them."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    counts = rows.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange(width(rows.sparkSession), "name", "value").select("*", F.spark_partition_id().alias("part")), "shard-names")
    parts = counts.groupBy("name", "part").agg(F.sum("n").alias("n"))  # a row for each name and partition
    upto = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("name", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("name")).alias("total"))
    inside = Window.partitionBy("name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("*", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside")).join(F.broadcast(before), ["name", "part"])
    return placed.select("name", "value", F.expr(f"CAST(1 + (before + inside) * {(1 << bits) - 1} div total AS INT)").alias("cell"))


def shards(docs: DataFrame, n_shards: int, bits: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of ``docs``
    (doc_id, text, lang, source). Size: UTF-8 bytes plus 8; a null text has size 8, and the
    checksum of an empty text (0). Rows equal in all these columns may exchange places.
    Fewer rows than shards leave shards empty."""
    spark = docs.sparkSession
    thin = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
        F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).alias("meta"),
    )
    thin = written(thin, "shard-rows")
    # A text found once is placed by its own row; only the others need their group's.
    groups = thin.groupBy("size", "text_hash").agg(F.min("meta").alias("group_meta"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    groups = bounded(written(groups, "shard-groups"))  # a hot group's join can be split where both sides are tables
    placed = thin.join(groups, ["size", "text_hash"], "left")
    placed = placed.withColumn("meta", F.coalesce("group_meta", "meta")).select("*", "meta.lang", "meta.source")
    names = ["lang", "source", "length"]
    length = F.lpad(F.col("size").cast("string"), 12, "0").alias("length")  # in order as a string
    placed = placed.select("*", length)
    cells = written(quantised_names(thin.select("meta.lang", "meta.source", length), names, bits), "shard-cells")
    for name in names:
        own = bounded(cells.where(F.col("name") == name).select(F.col("value").alias(name), F.col("cell").alias(f"{name}_cell")))
        placed = placed.join(own, name, "left")
    cell = curve_index([F.coalesce(f"{name}_cell", F.lit(0)) for name in names], bits)
    keys = ["cell", "text_hash", "size", "doc_id"]
    ordered = placed.select(cell.alias("cell"), "text_hash", "size", "doc_id", "text_crc32").repartitionByRange(width(spark), *keys).sortWithinPartitions(*keys)
    ordered = written(ordered.select("doc_id", "size", "text_crc32", "cell", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "shard-order")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition of the sort.
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.col("place")
    ranked = ordered.join(F.broadcast(before), "part").select("*", rank.alias("rank"))
    shard = F.expr(f"rank * {n_shards} div total")
    start = F.expr(f"(shard * total + {n_shards} - 1) div {n_shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell"
    )
