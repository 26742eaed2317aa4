"""Small tables with every awkward case, and brute-force versions of the operators."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
LABELS = T.StructType([T.StructField(c, T.IntegerType() if c != "doc_id" else T.LongType()) for c in ("doc_id", "quality", "toxic")])
#: Names that the operators use inside.
CLASHES = ["row", "tag", "fp", "key", "start", "size", "copies", "held_out", "score", "taken", "kept", "part", "_row", "y", "h", "i", "at"]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty, blank, very long, equal, near-equal and periodic texts, shared passages, repeated rows."""
    passage, long = words(70, 1), words(6000, 2)
    near = words(300, 3)
    rows = [
        (1, words(120, 4), "en", "a", 10), (2, None, "en", "a", 0), (3, "", "fr", "b", 0), (4, " \n\t ", "de", None, 4),
        (5, words(30, 5) + " " + passage + " " + words(25, 6), "en", "a", 1), (6, passage, None, "b", 1),
        (7, words(50, 7) + "\n" + passage, "es", "c", 1), (8, long, "en", "a", None), (9, near, "en", "b", 1),
        (10, near.replace(near.split()[5], near.split()[5] + "x", 1), "en", "b", 1), (11, words(120, 4), "en", "c", 1),
        (12, "Ha " * 400, "en", "a", 1), (13, "a" * 3000, "en", "a", 1), (14, "né à l'été — straße 日本 <|endoftext|> 😀 don't", "fr", "é", 1),
        (15, "one", "en", "a", 1), (16, "one two", "en", "a", 1), (17, "you are a worthless idiot and a moron", "en", "z", 1),
        (None, words(40, 8), "en", "a", 1), (None, words(40, 9), None, None, None), (18, words(60, 10), "en", "a", 1), (18, words(60, 10), "en", "a", 1),
    ]
    return rows


def docs_of(spark, rows=None, extra=False):
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, DOCS)
    if extra:
        for c in CLASHES:
            df = df.withColumn(c, F.lit("extra"))
    return df


def labels_of(spark, rows=None):
    rows = [(1, 1, 0), (5, 1, 0), (6, 0, 0), (17, 1, 1), (None, 1, 1), (9, None, None), (10, 1, 0), (10, 1, 1)] if rows is None else rows
    return spark.createDataFrame(rows, LABELS).withColumn("text", F.lit("extra"))
