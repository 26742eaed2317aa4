"""Whole-word dictionary lookup in free text as an equi-join.

Texts are cut into word and separator tokens; every run of up to ``k`` words
(separators included, so the match is literal) becomes a join key against the
dictionary. Work grows with the text length, not with text x dictionary size,
and neither side has to fit on one machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.functions import text as X


def _runs(toks: Column, longest: Column) -> Column:
    starts = X.word_starts(toks)
    run = lambda i, n: F.struct(
        i.alias("start"), n.alias("words"), F.array_join(F.slice(toks, i, 2 * n - 1), "").alias("found")
    )
    fits = lambda i, n: i + 2 * n - 2 <= F.size(toks)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), longest),
            lambda n: F.transform(F.filter(starts, lambda i: fits(i, n)), lambda i: run(i, n)),
        )
    )


def phrase_matches(texts: DataFrame, text_col: str, terms: DataFrame, plural: bool = False) -> DataFrame:
    """Every occurrence of a term between word boundaries, case-insensitively.

    ``texts``: key columns plus ``text_col``; ``terms(term)`` in lower case.
    Returns the key columns, ``start`` and ``words`` (token position and number of
    words), ``term`` and ``found`` (as written). With ``plural`` a trailing s is
    allowed; ``found`` then still has the term's length.
    """
    keys = [c for c in texts.columns if c != text_col]
    words_in = (F.size(X.word_starts(X.tokens(F.col("term")))))
    longest = terms.agg(F.coalesce(F.max(words_in), F.lit(1)).alias("k")).select("k").scalar()
    toks = texts.select(*keys, X.tokens(F.col(text_col)).alias("_toks")).withColumn("_k", longest)
    runs = toks.select(*keys, F.inline(_runs(F.col("_toks"), F.col("_k"))))
    lowered = F.lower("found")
    if plural:
        singular = F.when(F.endswith(lowered, F.lit("s")), F.substring(lowered, F.lit(1), F.length(lowered) - 1))
        runs = runs.withColumn("term", F.explode(F.array_compact(F.array(lowered, singular))))
    else:
        runs = runs.withColumn("term", lowered)
    hits = runs.join(terms.select("term").distinct(), "term")
    found = F.substring(F.col("found"), F.lit(1), F.length("term"))
    return hits.select(*keys, "start", "words", "term", found.alias("found"))


def _without_overlaps(keys: list[str]):
    """Scan of hits sorted by key and start; a hit that begins inside the last one kept is dropped."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = None, 0
        for batch in batches:
            column = lambda name: batch.column(name).to_pylist()
            keep = []
            for *key, start, words in zip(*map(column, keys), column("start"), column("words")):
                if key != place:
                    place, last = key, 0
                keep.append(start > last)
                if keep[-1]:
                    last = start + 2 * words - 2
            yield batch.filter(pa.array(keep, pa.bool_()))

    return scan


def leftmost_longest(matches: DataFrame, *keys: str) -> DataFrame:
    """Drop overlaps the way one scan with an alternation would: leftmost first, then longest term.

    The longest term of a start is settled by an aggregation. The rest is one pass over hits
    in order of their place, which holds the end of the last hit kept and nothing else.
    """
    hit = F.struct((-F.length("term")).alias("neg_len"), "words", "term", "found")
    longest = matches.groupBy(*keys, "start").agg(F.min(hit).alias("hit"))
    hits = longest.select(*keys, "start", "hit.words", "hit.term", "hit.found")
    ordered = hits.repartition(*keys).sortWithinPartitions(*keys, "start")
    return ordered.mapInArrow(_without_overlaps(list(keys)), hits.schema)
