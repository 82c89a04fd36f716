"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position; dynamic
programming keeps the best score and the number of pieces for each position, and no path.
Tie rules are those of unigram tokenizers: a later candidate replaces an earlier one only
with a higher score, and candidates come with the earliest start first, so the longest
piece wins a tie. A character that no piece of its own covers scores ten below the lowest
piece and counts as its UTF-8 bytes where the vocabulary has all byte pieces (else as one
unknown piece; unknown pieces in a row count once).

Spaces become U+2581 and one is put in front, as the vocabulary's own normaliser does. No
piece holds U+2581 after another character; so text can be cut before each run of U+2581
without changing the best path, and the counts of the cut parts are remembered. Should a
vocabulary hold such a piece, the text is not cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: How far an uncovered character scores below the lowest piece; fixed by the tokenizers.
UNKNOWN_PENALTY = 10.0
CACHE = 300_000


def vocabulary(model_path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the pieces that can match text, and whether all 256 byte pieces exist."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not special[i]], sum(sp.is_byte(i) for i in range(n)) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool):
        self.automaton = ahocorasick.Automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max((len(p) for p, _ in pieces), default=1)
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_known = bytes_known
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces) else None
        self._known: dict[str, tuple[int, float]] = {}

    def viterbi(self, part: str) -> tuple[int, float]:
        """Pieces and score of the best path through ``part``. Only the places that the longest piece
        reaches back to are held, so a long text without spaces takes no more memory than a short one."""
        n, ring = len(part), self.longest + 1
        best, count, unknown_end = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(part)
        at, match = next(matches, (n, None))
        for i, ch in enumerate(part):
            here = []
            while at == i:
                here.append(match)
                at, match = next(matches, (n, None))
            if len(here) > 1:
                here.sort(reverse=True)
            top, pieces, unk = None, 0, False
            for length, score in here:
                k = (i + 1 - length) % ring
                s = best[k] + score
                if top is None or s > top:
                    top, pieces, unk = s, count[k] + 1, False
            if ch not in self.single:
                k = i % ring
                s = best[k] + self.unknown
                if top is None or s > top:
                    more = len(ch.encode("utf-8", "surrogatepass")) if self.bytes_known else 0 if unknown_end[k] else 1
                    top, pieces, unk = s, count[k] + more, True
            k = (i + 1) % ring
            best[k], count[k], unknown_end[k] = top, pieces, unk
        return count[n % ring], best[n % ring]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text; an empty text has none."""
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if self.cut is None or not self.bytes_known:
            return self.viterbi(marked)
        known, pieces, total = self._known, 0, 0.0
        for part in self.cut.findall(marked):
            got = known.get(part)
            if got is None:
                got = self.viterbi(part)
                if len(part) <= 48:
                    if len(known) >= CACHE:
                        known.clear()
                    known[part] = got
            pieces += got[0]
            total += got[1]
        return pieces, total


@lru_cache(maxsize=4)
def counter(model_path: str) -> Counter:
    return Counter(*vocabulary(model_path))


def _count(model_path: str) -> Callable:
    def run(batches):
        c = counter(model_path)
        for batch in batches:
            got = [c.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and score (of the best segmentation) for each row of ``docs``
    (doc_id, text); a null or empty text has 0 tokens and score 0. ``model_path`` is a
    vocabulary file that each worker can open."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_count(model_path), "doc_id bigint, n_tokens bigint, score double")
