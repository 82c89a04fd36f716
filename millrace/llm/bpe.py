"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``chunk`` characters which overlap by ``overlap``. Chunks are
pre-tokenised in parallel. Where a chunk's boundaries meet one that its predecessor also
has, both agree from there on, because a match depends on nothing before its start; there
the two lists are stitched. The pieces between the stitched boundaries are then encoded.
Where an overlap holds no common boundary (a run of letters longer than it), the stitcher
scans on from the last sure boundary until it meets one of the next chunk.

A text of one chunk needs no stitching and is encoded where it is read; only the chunks of
longer texts are dealt out over the cluster.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import width
from millrace.llm.words import sliced

#: Characters after a match that can still change it: two for the contractions. This holds for the public
#: tokenizers' PATTERN and any other whose matches end by at most so many characters beyond them; a
#: pattern that can take up a run of spaces for the sake of a later line end isn't one.
LOOKAHEAD = 3
CACHE = 150_000


class Coder:
    """Ranks of one vocabulary file, with the ids of pieces met before."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: token for token, i in ranks.items()}
        self._core = tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._ids: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        ids = self._core._encode_single_piece(piece)
        if len(piece) <= 40:
            if len(self._ids) >= CACHE:
                self._ids.clear()
            self._ids[piece] = ids
        return ids

    def pieces(self, pieces: list[str]) -> list[int]:
        known, out = self._ids.get, []
        for p in pieces:
            out += known(p) or self.piece(p)
        return out

    def ends(self, text: str, last: bool) -> np.ndarray:
        """Ends of the pre-tokens of a chunk; without ``last``, of those that no
        character beyond the chunk can change."""
        ends = np.fromiter((m.end() for m in self.pattern.finditer(text)), dtype=np.int64)
        return ends if last else ends[ends <= len(text) - LOOKAHEAD]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(start, chunk, whether it reaches the end) of a text."""
    for start in range(0, max(len(text), 1), chunk):
        part = text[start : start + chunk + overlap]
        last = start + len(part) >= len(text)
        yield start, part, last
        if last:
            return


def stitch(chunks: list[tuple[int, str, np.ndarray]], c: Coder) -> tuple[str, list[int]]:
    """The whole text and its pre-token ends, from chunks (start, text, sure ends within)."""
    text = "".join(part[: nxt[0] - start] for (start, part, _), nxt in zip(chunks, chunks[1:], strict=False)) + chunks[-1][1]
    true: list[int] = []
    reach = 0  # the last sure boundary
    for k, (start, _, ends) in enumerate(chunks):
        own = [int(e) + start for e in ends]
        if k == 0:
            true, reach = own, own[-1] if own else 0
            continue
        behind = set(true[np.searchsorted(true, start) :]) | {reach}
        at = next((i for i, e in enumerate(own) if e in behind), None)
        if at is None:
            mine = set(own)
            for m in c.pattern.finditer(text, reach):
                true.append(m.end())
                reach = m.end()
                if reach in mine or k + 1 < len(chunks) and reach > chunks[k + 1][0] + len(chunks[k + 1][1]):
                    break
            at = next((i for i, e in enumerate(own) if e == reach), None)
            if at is None:
                continue
        while true and true[-1] > own[at]:
            true.pop()
        true += own[at + 1 :] if true and true[-1] == own[at] else own[at:]
        reach = true[-1] if true else reach
    for m in c.pattern.finditer(text, reach):
        true.append(m.end())
    return text, true


SCHEMA = "doc_id bigint, ids array<int>, decoded binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _result(doc_ids: list, ids: list, c: Coder) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], schema=_ARROW)


def _whole(ranks_path: str, pattern: str) -> Callable:
    def run(batches):
        c = coder(ranks_path, pattern)
        for batch in sliced(batches):
            doc_ids, ids, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                ids.append(c.pieces(c.pattern.findall(text.as_py() or "")))
                held += len(ids[-1])
                if held > 1_000_000:
                    yield _result(doc_ids, ids, c)
                    doc_ids, ids, held = [], [], 0
            yield _result(doc_ids, ids, c)

    return run


def _cut(chunk: int, overlap: int) -> Callable:
    names = ["row", "doc_id", "start", "part", "last"]

    def run(batches):
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts = list(cut(text.as_py(), chunk, overlap))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts)), pa.array([doc_id] * len(parts), pa.int64()), pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts]), pa.array([p[2] for p in parts])], names=names)

    return run


def _ends(ranks_path: str, pattern: str) -> Callable:
    def run(batches):
        c = coder(ranks_path, pattern)
        for batch in batches:
            ends = [c.ends(part, last).astype(np.int32).tobytes() for part, last in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(ends, pa.binary())], names=["row", "doc_id", "start", "part", "ends"])

    return run


def _join_up(ranks_path: str, pattern: str) -> Callable:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        c = coder(ranks_path, pattern)
        group = group.sort_values("start")
        text, ends = stitch([(int(s), p, np.frombuffer(e, np.int32)) for s, p, e in zip(group["start"], group["part"], group["ends"], strict=True)], c)
        ids = c.pieces([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].to_numpy(), "ids": [ids], "decoded": [c.decode(ids)]})

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """doc_id, ids (token ids of the whole text) and decoded (the ids' bytes), a row for
    each row of ``docs`` (doc_id, text). A null or empty text has no ids and no bytes.
    ``ranks_path`` is a rank file that each worker can open."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    short = text.where(size <= chunk).mapInArrow(_whole(ranks_path, pattern), SCHEMA)
    parts = (
        text.where(size > chunk)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(_cut(chunk, overlap), "row bigint, doc_id bigint, start bigint, part string, last boolean")
        .repartition(width(docs.sparkSession), "row", "start")
        .mapInArrow(_ends(ranks_path, pattern), "row bigint, doc_id bigint, start bigint, part string, ends binary")
    )
    return short.union(parts.groupBy("row").applyInPandas(_join_up(ranks_path, pattern), SCHEMA))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
