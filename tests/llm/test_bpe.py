import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from millrace.llm import bpe, queries
from tests.llm.fixtures import empty, hard, hard_rows


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(rows):
    enc, out = reference(), []
    for doc_id, text, *_ in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_hard_rows_by_small_chunks(spark):
    for chunk, overlap in ((40, 12), (32_768, 512)):
        got = bpe.digest(bpe.encode(hard(spark), queries.RANKS, P.PATTERN, chunk, overlap)).collect()
        assert sorted(map(tuple, got), key=str) == expected(hard_rows())


def test_stitching_meets_the_whole_text():
    rng, c = random.Random(3), bpe.coder(queries.RANKS, P.PATTERN)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "l", "1", "!", "é", "東", " ", "\x1c"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200)))
        chunk, overlap = rng.randrange(1, 30), rng.randrange(0, 12)
        parts = [(s, p, c.ends(p, last)) for s, p, last in bpe.cut(text, chunk, overlap)]
        whole, ends = bpe.stitch(parts, c)
        assert whole == text
        assert ends == [m.end() for m in c.pattern.finditer(text)]
        assert c.pieces(c.pattern.findall(text)) == reference_ids(text)


_ENC = reference()


def reference_ids(text):
    return _ENC.encode_ordinary(text)


def test_empty_table(spark):
    assert bpe.digest(bpe.encode(empty(spark), queries.RANKS, P.PATTERN)).count() == 0


def test_query(spark, sf):
    got = queries.op5_byte_bpe(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
