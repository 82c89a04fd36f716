"""Near-duplicates by SimHash and BK-trees.

Equal fingerprints are one node. Two fingerprints that differ in at most ``radius`` bits
agree in one of ``radius + 1`` blocks of bits; so each fingerprint goes to one shard for each
block, named by the block's value, and a search never has to leave its shards. In each
shard a Burkhard-Keller tree (children keyed by their Hamming distance to the parent) is
searched within the radius, following only edges within it, and grown. A shard reports a
spanning forest of its links, never its pairs.

A shard that is too large is dealt out again by the blocks of its remaining bits, by the
same argument, until the shards are small or no bits are left to split: groups of
fingerprints that share most of their bits do not pile up in one task.

Trees stay where their shard is, as the shards together grow with the data; none is
broadcast.

The links are joined into components by distributed hooking and shortcutting.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import bounded, without_rows, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Nodes of a shard beyond which it is split by further blocks.
SHARD = 2_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest, sums = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)), np.uint64)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int) -> Callable:
    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "version", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, version (xxhash64 of the text) and fp (a signed long of the 64 bits) for each row of
    ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id bigint, version bigint, fp bigint")


class Tree:
    """A Burkhard-Keller tree of 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Values within ``radius``."""
        out, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            k = todo.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                out.append(values[k])
            below = children[k]
            if below:
                todo += [c for edge, c in below.items() if d - radius <= edge <= d + radius]
        return out

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, k = len(self.values) - 1, 0
        while new:
            d = (self.values[k] ^ value).bit_count()
            nxt = self.children[k].setdefault(d, new)
            if nxt == new:
                return
            k = nxt


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its component) for all that are linked to a smaller one,
    in a shard of distinct values."""
    tree, parent = Tree(), {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in values:
        for other in tree.near(v, radius):
            a, b = root(v), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, root(v)) for v in values if root(v) != v]


def _search(radius: int) -> Callable:
    def run(batches):
        """Batches of (shard key, fps of the shard)."""
        for batch in batches:
            links: list[tuple[int, int]] = []
            for fps in batch.column(0):
                links += forest([v & 0xFFFFFFFFFFFFFFFF for v in fps.as_py()], radius)
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks that share out the given bit numbers among n blocks."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, np.int64), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect exactly what lies within ``radius``, of ``nodes`` (fp, distinct)."""
    out: DataFrame | None = None
    # (mask of the bits that a shard's members share, its value) is a shard's key.
    level = nodes.select("fp", F.lit(0).cast("bigint").alias("mask"), F.lit(0).cast("bigint").alias("value"))
    fixed = [0]
    while fixed:
        routes = []
        for mask in fixed:
            free = [b for b in range(64) if not mask >> b & 1]
            routes.append((mask, [mask | m for m in _blocks(free, radius + 1)]))
        masks = [(_signed(mask), [_signed(m) for m in wider]) for mask, wider in routes]  # at most (radius + 1)^level rows
        masks = F.broadcast(nodes.sparkSession.createDataFrame(masks, "mask bigint, wider array<bigint>"))
        dealt = level.join(masks, "mask").select("fp", F.explode("wider").alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        sizes = written(sizes, "simhash-sizes")  # a hot shard's join can be split where neither side is grouped in it
        sized = written(dealt.join(sizes, ["mask", "value"]), "simhash-shards")
        last = any(64 - bin(m).count("1") <= 2 * (radius + 1) for _, wider in routes for m in wider)
        # At most 2^(free bits) members are left in a shard of the last level.
        small = sized if last else sized.where(F.col("n") <= shard)
        shards = small.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = shards.mapInArrow(_search(radius), "a bigint, b bigint")
        out = found if out is None else out.union(found)
        if last:
            break
        level = sized.where(F.col("n") > shard).select("fp", "mask", "value")
        fixed = [int(r["mask"]) & 0xFFFFFFFFFFFFFFFF for r in level.select("mask").distinct().collect()]  # at most (radius + 1)^level masks
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node connected with it.

    Each round hooks every node's root to the smallest root next to it, then shortcuts the
    roots; it ends when all edges lie within one root."""
    edges = written(edges.where("a <> b"), "component-edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "component-roots")
    while True:
        # Shortcut: roots of roots.
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = written(roots.join(up, "root").select("node", F.col("above").alias("root")), "component-roots")
        r = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        s = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        open_ = edges.join(r, "a").join(s, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("high"), F.least("ra", "rb").alias("low"))
        hooks = written(open_.groupBy("high").agg(F.min("low").alias("low")), "component-hooks")
        if hooks.isEmpty():
            # A root is never larger than its node, and the smallest node is its own root.
            return roots
        h = hooks.select(F.col("high").alias("root"), "low")
        roots = roots.join(h, "root", "left").select("node", F.coalesce("low", "root").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """doc_id, version, fp, root (the component's smallest fp as a long) and component_id (the
    smallest doc_id connected by links) for each row of ``docs`` (doc_id, text). Texts without words have fingerprint 0 and are linked like any
    other. A null id names a component only where all its ids are null."""
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = written(nodes, "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius, shard))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "version", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of ``docs``, as it is: that of the smallest doc_id, null being
    larger than any; of rows of one doc_id, one of the smallest hash of the text."""
    return first_of_each(docs, near_duplicates(docs, radius, shingle))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each`` keeps, given the doc_id, version and root of each."""
    rows = written(found.select("doc_id", "version", "root"), "near-components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    first = rows.groupBy("root").agg(F.min(order).alias("first")).select("root", "first.doc_id", "first.version")
    same = F.expr("r.root = f.root AND r.doc_id <=> f.doc_id AND r.version = f.version")
    left = without_rows(docs, rows.alias("r").join(first.alias("f"), same, "left_anti"))
    again = written(rows.groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")), "simhash-repeated")
    if again.isEmpty():
        return left
    # Of rows that repeat as a whole, the first stays.
    repeated = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    once = left.join(bounded(again), repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(bounded(again), repeated, "left_anti").unionByName(once)


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
