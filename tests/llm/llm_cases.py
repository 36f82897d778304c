"""Small document tables with the awkward cases every operator must take."""

import random

from pyspark.sql import Row
from pyspark.sql import types as T

#: Columns beside doc_id and text have names that operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.LongType()),
                       T.StructField("kept_text", T.StringType()), T.StructField("__lines", T.StringType()), T.StructField("fp", T.StringType()),
                       T.StructField("rest", T.StringType())])


def prose(seed, n, words=None):
    r = random.Random(seed)
    words = words or ["".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


def documents(spark, texts):
    """texts: pairs (doc_id, text)."""
    rows = [Row(doc_id=i, text=t, lang="en", source=None, n_chars=None if t is None else len(t), row=1, kept_text="x", fp=None, rest="y",
                **{"__lines": "z"}) for i, t in texts]
    return spark.createDataFrame([tuple(r[f.name] for f in SCHEMA) for r in rows], SCHEMA)


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows and equal texts."""
    shared = prose(1, 70)
    return [(5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, prose(2, 40_000)), (10, f"{prose(3, 20)}\n{shared}\n{prose(4, 20)}"),
            (11, f"{prose(5, 30)} {shared} {prose(6, 10)}"), (12, "漢字かな交じり文。" * 40), (13, "don't  stop\r\n it's 12½ \U0001F600!"),
            (14, f"{prose(3, 20)}\n{shared}\n{prose(4, 20)}"), (14, f"{prose(3, 20)}\n{shared}\n{prose(4, 20)}"), (14, "another text under the same id"),
            (None, shared), (None, None), (-3, prose(7, 120)), (15, prose(7, 120)), (16, "a" * 5000)]
