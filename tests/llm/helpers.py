"""Small corpora for the operator tests."""

import random

from pyspark.sql import types as T

#: The columns of documents, and some that operators use as names themselves.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("_id", T.StringType()),
])


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "y", "z", "c", "i") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, most=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(most)}" for _ in range(n)]


def text(n, seed, per_line=12):
    w = words(n, seed)
    return "\n".join(" ".join(w[k : k + per_line]) for k in range(0, n, per_line))
