import random

import numpy as np
import xxhash

from millrace.llm import queries, simhash
from tests.llm.fixtures import empty, hard, hard_rows


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component_id) by all pairs."""
    rows = [(r[0], brute_fingerprint(r[1])) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(ids, default=None)
    return sorted(((d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(rows)), key=str)


def shown(df):
    return sorted(map(tuple, df.select("doc_id", simhash.hexadecimal("fp"), "component_id").collect()), key=str)


def test_hard_rows(spark):
    assert shown(simhash.near_duplicates(hard(spark))) == brute(hard_rows())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_tree_finds_what_brute_force_finds():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(20)})
    tree = simhash.Tree()
    for v in values:
        tree.add(v)
    for v in values[:100]:
        assert sorted(tree.near(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


def test_links_through_all_levels_of_shards(spark):
    """A dense ball of fingerprints, dealt out again down to the last level."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 300:
        v = rng.choice(sorted(values)) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(64))
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    want = dict.fromkeys(signed)
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2]
    root = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for shard in (2, 2000):
        got = dict(map(tuple, simhash.components(simhash.links(nodes, shard=shard)).collect()))
        linked = {v for p in pairs for v in p}
        assert got == {v: root[v] for v in want if v in linked}


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (7, 7)], "a bigint, b bigint")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op9_simhash_near_dedup(spark, sf).collect()), key=str) == brute(rows)
