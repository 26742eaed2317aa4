"""Seriousness counts per pair and their shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark import constants as K
from oddspark.functions.special import round4
from oddspark.operators import baskets as B


def pair_severity(baskets: DataFrame) -> DataFrame:
    """Reports with each outcome flag per pair, one pass; a basket is one report, so no distinct is needed."""
    counts = B.report_pairs(B.eligible(baskets), *K.OUTCOMES).groupBy("drug", "reaction_pt").agg(
        F.count(F.lit(1)).alias("a"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in K.OUTCOMES]
    )
    return with_shares(counts)


def attach_severity(pairs: DataFrame, severity: DataFrame) -> DataFrame:
    """Left join, missing counts as 0."""
    joined = pairs.join(severity.select("drug", "reaction_pt", *K.OUTCOMES), ["drug", "reaction_pt"], "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in K.OUTCOMES})
    return joined.withColumn("severity_base_ok", base_ok())


def base_ok():
    return F.greatest(*[F.col(c) for c in K.OUTCOMES]) <= F.col("a")


def with_shares(counts: DataFrame) -> DataFrame:
    """Share of the pair's reports per outcome, left out where the count exceeds them."""
    share = lambda c: F.when((F.col(c) <= F.col("a")) & (F.col("a") > 0), round4(F.col(c) / F.col("a")))
    return counts.withColumn("severity_base_ok", base_ok()).withColumns({f"{c}_share": share(c) for c in K.OUTCOMES})
