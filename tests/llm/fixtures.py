"""A small table of hard cases, for every operator on documents."""

import random

from pyspark.sql import types as T

#: Extra columns whose names operators use inside or return.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("shard", "fp", "spans", "place", "anchor", "n_words", "score", "kept", "row", "part", "value")]
)


def sentence(rng, n, words=400):
    return " ".join(rng.choice(["the", "of", "and", "le", "un"]) if rng.random() < 0.3 else f"w{rng.randrange(words)}" for _ in range(n))


def hard_rows(seed=7):
    rng = random.Random(seed)
    shared = sentence(rng, 45)
    long = sentence(rng, 9000)
    texts = [None, "", " \t\n\x0b\f\r ", "one", "Über éCOLE 東京 \U0001f600 don't we'LL", "a b", "  x\u0085y", "12 34", "." * 300]
    texts += [sentence(rng, rng.randrange(1, 120)) for _ in range(25)]
    texts += [f"{sentence(rng, 7)} {shared}\n{sentence(rng, 9)}" for _ in range(6)]
    texts += [shared, shared, f"{shared} {shared}", " ".join(["same"] * 80), " ".join(["same"] * 81)]
    texts += [long, long + " tail", "x" * 70_000, "y " * 40_000]
    near = sentence(rng, 200, 5000)
    for _ in range(8):
        words = near.split()
        words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += [near] * 5
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, near), (None, None), rows[3], rows[3], (rows[5][0], "another text of a repeated id " + shared)]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None]), None if t is None else len(t), *["z"] * 11) for i, t in rows]


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
