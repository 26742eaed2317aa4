"""Substring search as an equi-join on runs of three characters.

A needle can only stand in a text that has all its trigrams, so it is looked up by the
rarest of them, and only what has that one is compared. The index is linear in the
length of the texts, and only runs that some needle has enter it; needles with a
trigram that occurs nowhere go at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.sources.sinks import publish

SIZE = 3


def grams(text: Column, n: int, pattern: str | None = None) -> Column:
    """Distinct runs of ``n`` characters; ``pattern`` names those wanted."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({pattern or '.' * n}))"), 1))


def _needle_grams(needle: Column, pattern: str | None = None) -> Column:
    """The trigrams of a needle; one that is shorter is its own."""
    return F.when(F.length(needle) >= SIZE, grams(needle, SIZE, pattern)).otherwise(F.array(needle))


def rarest(needles: DataFrame, postings: DataFrame, pattern: str | None = None) -> DataFrame:
    """``needles(needle)`` with ``gram``, the one that occurs least in ``postings(gram)``; without those that cannot occur."""
    counted = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    parts = needles.select("needle", F.explode(_needle_grams(F.col("needle"), pattern)).alias("gram")).join(counted, "gram", "left")
    best = parts.groupBy("needle").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"), F.bool_or(F.col("_n").isNull()).alias("_absent"))
    return best.where(~F.col("_absent")).select("needle", "gram")


def substring_matches(needles: DataFrame, words: DataFrame) -> DataFrame:
    """``needle, word`` wherever a word of ``words(word)`` contains a needle of ``needles(needle)``; both without repeats."""
    asked = needles.where(F.col("needle") != "")
    sizes = asked.agg(F.collect_set(F.least(F.length("needle"), F.lit(SIZE))).alias("sizes")).select("sizes").scalar()
    cut = lambda n: F.when(F.array_contains("_sizes", n), grams(F.col("word"), n)).otherwise(F.array().cast("array<string>"))
    all_sizes = F.concat(*(cut(n) for n in range(1, SIZE + 1)))
    wanted = asked.select(F.explode(_needle_grams(F.col("needle"))).alias("gram")).distinct()
    postings = words.withColumn("_sizes", sizes).select("word", F.explode(all_sizes).alias("gram")).join(wanted, "gram", "left_semi")
    postings = publish(postings, "postings")
    found = rarest(asked, postings).join(postings, "gram")
    return found.where(F.contains("word", "needle")).select("needle", "word")
