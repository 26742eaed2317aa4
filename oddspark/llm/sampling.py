"""Labelled rows that may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of_id(col: str = "doc_id") -> Column:
    """CRC-32 of the id as decimal text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def learnable(labels: DataFrame, label: str, fold: Column, most: int | None = None) -> DataFrame:
    """``doc_id, y``: labelled documents outside the held-out fold, all or at most ``most`` drawn by a hash of the id.

    Several labels of one document count as 1 if any is. Rows without id or label
    teach nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~fold)
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    if most is None:
        return each
    return each.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
