import random
import tracemalloc

import sentencepiece
from tokenizers import Tokenizer, models

from millrace.llm import queries, unigram
from tests.llm.fixtures import empty, hard, hard_rows


def reference():
    """The same vocabulary in the tokenizers library's unigram model, which adds scores in doubles."""
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.UNIGRAM_VOCABULARY)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))


REFERENCE = reference()


def expected(text):
    return len(REFERENCE.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_random_texts():
    rng, c = random.Random(5), unigram.counter(queries.UNIGRAM_VOCABULARY)
    alphabet = ["a", "th", "e", "ing", " ", "  ", "    ", "\n", "é", "東", "\U0001f600", "1", "▁", "."]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        assert c.text(text)[0] == expected(text), text


def test_ties_and_unknown_pieces():
    # ab+c and a+bc score alike; the longest piece that ends last wins.
    c = unigram.Counter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -1.5), ("bc", -1.5)], True)
    assert c.viterbi("abc") == (2, -2.5)
    assert c.viterbi("a東c")[0] == 5
    assert unigram.Counter([("a", -1.0)], False).viterbi("a東京a")[0] == 3
    # A piece across a space: text is not cut.
    assert unigram.Counter([("a▁a", -1.0), ("a", -1.0), ("▁", -1.0)], True).text("a a") == (2, -2.0)


def brute(part, pieces, unknown):
    """(pieces, score): all cuts of a text, by one table of whole prefixes; longer pieces first."""
    best = [(0, 0.0)]
    for end in range(1, len(part) + 1):
        top = None
        for start in range(end):
            piece = part[start:end]
            if piece in pieces:
                found = best[start][0] + 1, best[start][1] + pieces[piece]
            elif end - start == 1:
                found = best[start][0] + len(piece.encode()), best[start][1] + unknown
            else:
                continue
            if top is None or found[1] > top[1]:
                top = found
        best.append(top)
    return best[-1]


def test_counts_and_scores_against_all_prefixes():
    rng, known = random.Random(6), unigram.vocabulary(queries.UNIGRAM_VOCABULARY)[0]
    c = unigram.counter(queries.UNIGRAM_VOCABULARY)
    for _ in range(60):
        text = "".join(rng.choice(["a", "th", "e", "ing", " ", "é", "東", "1", ".", "qu", "zzz"]) for _ in range(rng.randrange(1, 40)))
        want = brute("▁" + text.replace(" ", "▁"), dict(known), c.unknown)
        got = c.text(text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9, text


def test_memory_of_a_long_text_without_spaces():
    c = unigram.counter(queries.UNIGRAM_VOCABULARY)
    c.viterbi("ab" * 100)
    tracemalloc.start()
    try:
        c.viterbi("abcdefghij" * 30_000)
        assert tracemalloc.get_traced_memory()[1] < 8 * 300_000  # the text itself takes four bytes a character
    finally:
        tracemalloc.stop()


def test_hard_rows(spark):
    got = unigram.count_tokens(hard(spark), queries.UNIGRAM_VOCABULARY).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, expected(t)) for i, t, *_ in hard_rows()), key=str)
    assert unigram.count_tokens(empty(spark), queries.UNIGRAM_VOCABULARY).count() == 0


def test_query(spark, sf):
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op10_token_counts(spark, sf).collect()
    assert len(got) == len(texts) and all(r["n_tokens"] == expected(texts[r["doc_id"]]) for r in got)
