"""Small tables and brute-force versions for the tests of almagest.llm."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs_of(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None)
            for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, control characters."""
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (None, "only words without an id"), (4, "one"), (5, "two words"),
            (6, "a b c"), (6, "a b c"), (7, "a b c"), (7, "another text of the same id"), (None, None),
            (8, "naïve café — ünïcödé     text"), (9, "x" * 5000), (10, "nul\x00byte and tab\there")]


def with_clashes(docs):
    """Extra columns named like those that operators make for themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("extra") for c in ("k1", "k2", "fp", "spans", "size", "bucket", "component", "words",
                                                         "score", "kept", "edits", "position", "count", "row", "at", "nth",
                                                         "__k1", "__k2", "__nth", "__at", "__row", "__left", "__spans", "__of", "__gone")})
