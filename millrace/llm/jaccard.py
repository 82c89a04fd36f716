"""Near-duplicates by Jaccard similarity of five-word shingles, 0.8 or more, for the pipeline.

Rows of equal shingle sets are one node. Candidates come from two searches. Nodes whose SimHash
fingerprints (of the same shingles) are within two bits are found by operator 9's BK-trees; that is
about half of the pairs at this similarity, whose fingerprints are some seven bits apart, and no
tree can be pruned at a radius that holds the others. These come from MinHash: ``BANDS`` keys of
``ROWS`` minima each, so that two nodes of similarity 0.8 share a key with a probability of 0.99993,
and those of higher similarity with more. Nodes that share a key are linked through its smallest
node, never in pairs, into coarse groups, and similarities within a group are computed exactly:

- A group of at most ``SMALL`` nodes is compared as a whole in one task.
- In a larger one, nodes of which more than a fifth of the shingles are found in no other node of the
  group have no link, whatever they resemble; a much changed copy is such a node. All others are
  compared with pivots among them, ``BLOCK`` nodes with ``PIVOTS`` pivots in a task. Once a node has
  been a pivot, all its links are known. The first pivots are any; the next ones are the nodes
  outside of the group's largest component. When each of those has been a pivot, no link between
  two components can be missing. So a hot group of near copies costs its nodes times those outside
  of the component that most of them are in, and never meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.simhash import _LOWER, components, first_of_each, links
from millrace.llm.store import bounded, written
from millrace.llm.words import sliced

SHINGLE = 5
BANDS, ROWS = 24, 5
SEED = 42
RADIUS = 2
#: Nodes of a group that is compared in one task; pivots and nodes of a larger one that are.
SMALL, PIVOTS, BLOCK = 256, 128, 1_000

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; of all its words if they are fewer than
    a shingle's; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n))


def band_keys(tokens: np.ndarray) -> np.ndarray:
    """The keys of a set's bands; of the empty set all are of the largest minimum."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 512):
        least = np.minimum(least, ((tokens[at : at + 512] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    raw = least.tobytes()
    return np.fromiter((xxhash.xxh64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)), np.uint64, BANDS)


def fingerprint(tokens: np.ndarray) -> int:
    """The SimHash of a set of hashes, 0 of the empty one."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(tokens), 65_536):
        ones += np.unpackbits(tokens[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(tokens), bitorder="little").view(np.uint64)[0])


def _signatures(batches):
    """doc_id, version, node (a digest of the shingle set), fp and bands of (doc_id, text, version)."""
    for batch in sliced(batches):
        nodes, fps, keys = [], [], []
        for t in batch.column(1):
            s = shingles(t.as_py())
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            fps.append(fingerprint(s))
            keys.append(band_keys(s))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), pa.array(np.array(keys, np.uint64).reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), bands], names=["doc_id", "version", "node", "fp", "bands"])


def _sets(batches):
    """grp, n, node and tokens of (grp, n, node, text)."""
    for batch in sliced(batches):
        tokens = pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(3)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), tokens], names=["grp", "n", "node", "tokens"])


class Overlap:
    """Similarities of a set with some fixed ones."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def near(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the fixed sets whose similarity with the set is 4/5 or more."""
        low, high = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        found = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(found)[:-1])), found) + np.arange(found.sum()) if len(found) else found
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        # shared / (a + b - shared) >= 4 / 5; two empty sets are alike.
        return np.flatnonzero(9 * shared >= 4 * (self.sizes + len(tokens)))


class Union:
    """Numbers in joined sets."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, v: int) -> int:
        parent = self.parent
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    def join(self, a: int, b: int) -> None:
        self.parent[self.root(b)] = self.root(a)


def forest(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) of all that are linked to a smaller one, where sets of
    similarity 4/5 and above are linked."""
    order = np.argsort(np.array(nodes, np.int64), kind="stable").tolist()
    nodes, sets = [nodes[k] for k in order], [sets[k] for k in order]
    overlap, joined = Overlap(sets), Union(len(nodes))
    for v, s in enumerate(sets):
        for w in overlap.near(s).tolist():
            a, b = joined.root(v), joined.root(w)
            joined.join(min(a, b), max(a, b))
    return [(n, nodes[joined.root(v)]) for v, n in enumerate(nodes) if joined.root(v) != v]


def _unsigned(lists) -> list[np.ndarray]:
    return [t.values.to_numpy(zero_copy_only=False).view(np.uint64) for t in lists]


def _verified(group: pa.Table) -> pa.Table:
    pairs = np.array(forest(group["node"].to_pylist(), _unsigned(group["tokens"])), np.int64).reshape(-1, 2)
    return pa.table({"node": pa.array(pairs[:, 0]), "root": pa.array(pairs[:, 1])})


def _against_pivots(block: pa.Table) -> pa.Table:
    """(a, b): links between the pivots and the other nodes of a block of (grp, block, of, node, pivot, tokens)."""
    is_pivot = block["pivot"].to_numpy()
    pivots, others = block.filter(pa.array(is_pivot)), block.filter(pa.array(~is_pivot))
    names, overlap = pivots["node"].to_pylist(), Overlap(_unsigned(pivots["tokens"]))
    # A row for each node and pivot at most: pivots that have a node in common are linked.
    joined, first = Union(len(names)), []
    for node, tokens in zip(others["node"].to_pylist(), _unsigned(others["tokens"]), strict=True):
        near = overlap.near(tokens).tolist()
        for k in near[1:]:
            joined.join(near[0], k)
        first += [(node, near[0])] if near else []
    links_ = [(node, names[joined.root(k)]) for node, k in first] + [(n, names[joined.root(k)]) for k, n in enumerate(names)]
    pairs = np.array([x for x in links_ if x[0] != x[1]], np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _linkable(sets: DataFrame) -> DataFrame:
    """The rows of ``sets`` (grp, n, node, tokens) without those that have too many shingles of their own."""
    token = sets.select("grp", "node", F.explode("tokens").alias("token")).groupBy("grp", "token").agg(F.count("*").alias("found"), F.min("node").alias("owner"))
    alone = written(token.where("found = 1").groupBy(F.col("owner").alias("node")).agg(F.count("*").alias("alone")), "jaccard-alone")
    return sets.join(bounded(alone), "node", "left").where(F.expr("5 * (size(tokens) - coalesce(alone, 0)) >= 4 * size(tokens)")).select("grp", "n", "node", "tokens")


def _resolved(sets: DataFrame) -> DataFrame:
    """(node, root): the components of what is similar in the large groups of ``sets`` (grp, n, node, tokens)."""
    by_hash = Window.partitionBy("grp").orderBy(F.xxhash64("node"), "node")
    first = sets.select("grp", "node").withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= PIVOTS)
    pivots, found, tried = written(first.select("grp", "node"), "jaccard-pivots"), None, None
    dealt = lambda n, size: F.pmod(F.xxhash64("node"), F.ceil(n / size).cast("bigint"))
    every = lambda n, size: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / size).cast("bigint") - 1))
    while True:
        counts = bounded(written(pivots.groupBy("grp").agg(F.count("*").alias("p")), "jaccard-pivot-counts"))
        counted = written(sets.join(counts, "grp"), "jaccard-round")
        others = counted.select("grp", dealt(F.col("n"), BLOCK).alias("block"), every(F.col("p"), PIVOTS).alias("of"), "node", F.lit(False).alias("pivot"), "tokens")
        chosen = counted.join(bounded(pivots), ["grp", "node"]).select("grp", every(F.col("n"), BLOCK).alias("block"), dealt(F.col("p"), PIVOTS).alias("of"), "node", F.lit(True).alias("pivot"), "tokens")
        links_ = written(others.union(chosen).groupBy("grp", "block", "of").applyInArrow(_against_pivots, "a bigint, b bigint"), "jaccard-pivot-links")
        found = links_ if found is None else found.union(links_)
        tried = pivots if tried is None else tried.union(pivots)
        rooted = written(sets.select("grp", "node").join(components(found), "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root")), "jaccard-rooted")
        sizes = rooted.groupBy("grp", "root").agg(F.count("*").alias("n"))
        largest = written(sizes.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("most")).select("grp", F.col("most.root").alias("largest")), "jaccard-largest")
        outside = rooted.join(largest, "grp").where("root <> largest").select("grp", "node").join(tried, ["grp", "node"], "left_anti")
        pivots = written(outside, "jaccard-pivots")
        if pivots.isEmpty():
            return rooted.select("node", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, version (xxhash64 of the text) and root (its component's smallest node) for each row of
    ``docs`` (doc_id, text). Texts without words are all alike. Rows of one text are of one component,
    whatever their ids, null or repeated, are; an empty table gives an empty one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    signed = written(rows.mapInArrow(_signatures, "doc_id bigint, version bigint, node bigint, fp bigint, bands array<bigint>"), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "fp", "bands"))
    nodes = written(signed.groupBy("node").agg(first.alias("first")).select("node", "first.doc_id", "first.version", "first.fp", "first.bands"), "jaccard-nodes")
    # A fingerprint is a key like a band's; the trees link fingerprints.
    keyed = nodes.select("node", F.explode(F.concat("bands", F.array("fp"))).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "jaccard-keys")
    edges = keyed.join(shared, "key").where("node <> least").select("node", "least").distinct()
    of_fp = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "jaccard-fingerprints")
    ends = [of_fp.select(F.col("fp").alias(x), F.col("least").alias(y)) for x, y in (("a", "x"), ("b", "y"))]
    trees = links(of_fp.select("fp"), RADIUS).join(ends[0], "a").join(ends[1], "b").select("x", "y")
    coarse = written(components(edges.union(trees).toDF("a", "b")).withColumnRenamed("root", "grp"), "jaccard-groups")
    sizes = written(coarse.groupBy("grp").agg(F.count("*").alias("n")), "jaccard-sizes")
    wanted = written(coarse.join(sizes, "grp").join(nodes.select("node", F.col("doc_id").alias("__id"), F.col("version").alias("__version")), "node"), "jaccard-wanted")
    texts = rows.join(bounded(wanted), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("version").eqNullSafe(F.col("__version"))).select("grp", "n", "node", "text")
    # A row that repeats as a whole is taken once.
    sets = written(texts.mapInArrow(_sets, "grp bigint, n bigint, node bigint, tokens array<bigint>").dropDuplicates(["node"]), "jaccard-sets")
    roots = written(sets.where(F.col("n") <= SMALL).groupBy("grp").applyInArrow(_verified, "node bigint, root bigint"), "jaccard-roots")
    large = sets.where(F.col("n") > SMALL)
    if not large.isEmpty():
        roots = roots.union(_resolved(written(_linkable(large), "jaccard-linkable")))
    return signed.join(roots, "node", "left").select("doc_id", "version", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, as it is: that of the smallest doc_id."""
    return first_of_each(docs, near_duplicates(docs))
