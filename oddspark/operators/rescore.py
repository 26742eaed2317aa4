"""Recompute statistics from stored cells, and compare with what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.functions import stats as S
from oddspark.functions.special import round4
from oddspark.operators import mgps as M


def ordered_bounds() -> Column:
    return (F.col("EB05") <= F.col("EBGM")) & (F.col("EBGM") <= F.col("EB95"))


def rescore(scored: DataFrame, params: M.Params | None = None) -> DataFrame:
    """New IC, tier and MGPS columns from ``a, b, c, d, N`` alone; fails on disordered bounds."""
    if params is None:
        params = M.fit(scored)
    base = scored.drop("IC", "IC025", "IC975", "tier", "signal", "expected", "EBGM", "EB05", "EB95")
    out = M.with_mgps(S.with_gates(S.with_bcpnn(base)), params)
    checked = F.when(F.coalesce(ordered_bounds(), F.lit(True)), F.col("EBGM")).otherwise(
        F.raise_error(F.lit("EB05 <= EBGM <= EB95 is violated")).cast("double")
    )
    return M.round_mgps(S.round_measures(out.withColumn("EBGM", checked)))


def tier_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs per (old tier, new tier) with the shift of IC025 among them."""
    old = before.select("drug", "reaction_pt", F.col("tier").alias("old_tier"), F.col("IC025").alias("_old"))
    new = after.select("drug", "reaction_pt", F.col("tier").alias("new_tier"), F.col("IC025").alias("_new"))
    shift = F.abs(F.col("_new") - F.col("_old"))
    return (
        old.join(new, ["drug", "reaction_pt"])
        .groupBy("old_tier", "new_tier")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            round4(F.avg(shift)).alias("mean_shift"),
            round4(F.median(shift)).alias("median_shift"),
            round4(F.max(shift)).alias("max_shift"),
        )
    )


def interval_width(scored: DataFrame) -> DataFrame:
    """Median width of the credible interval by amount of evidence."""
    a = F.col("a")
    band = F.when(a < 10, "a<10").when(a < 100, "a=10-99").when(a < 1000, "a=100-999").otherwise("a>=1000")
    width = F.col("IC975") - F.col("IC025")
    return scored.where("a >= 1").groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("pairs"), round4(F.median(width)).alias("median_width")
    )
