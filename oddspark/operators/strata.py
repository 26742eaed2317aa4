"""Optional cuts described for the method: roles, strata, reporter mix, pairwise baseline."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.functions import stats as S
from oddspark.functions.special import round4
from oddspark.operators import baskets as B
from oddspark.operators import counts as C


def score_by_stratum(baskets: DataFrame, stratum: str) -> DataFrame:
    """2x2 tables and ratios inside each stratum, all strata in one pass.

    The stratum travels inside the drug key, so marginals and N are the stratum's
    own without a loop over strata.
    """
    sep = "\x01"
    tag = F.col(stratum).cast("string")
    ok = B.eligible(baskets).where(F.col(stratum).isNotNull())
    tagged = ok.select(
        F.transform("drugs", lambda d: F.concat(tag, F.lit(sep), d)).alias("drugs"),
        F.transform("reactions", lambda r: F.concat(tag, F.lit(sep), r)).alias("reactions"),
    )
    cells = C.pair_counts(tagged)
    part = lambda c, i: F.substring_index(c, sep, 1 if i == 0 else -1)
    sizes = cells.groupBy(part("drug", 0).alias("stratum")).agg(F.sum("heads_both").alias("N"))
    table = (
        cells.select("drug", "reaction_pt", "a").join(C.drug_margin(cells), "drug").join(C.reaction_margin(cells), "reaction_pt")
        .select(part("drug", 0).alias("stratum"), part("drug", 1).alias("drug"), part("reaction_pt", 1).alias("reaction_pt"), "a",
                (F.col("n_drug") - F.col("a")).alias("b"), (F.col("n_reaction") - F.col("a")).alias("c"))
        .join(sizes, "stratum")
        .withColumn("d", F.col("N") - F.col("a") - F.col("b") - F.col("c"))
    )
    return S.with_ratios(table).select("stratum", "drug", "reaction_pt", "a", "b", "c", "d", "N", "ROR", "ROR_lower", "ROR_upper")


def simpson_check(strata: DataFrame, overall: DataFrame) -> DataFrame:
    """Pairs whose ratio lies on one side of 1 overall and on the other in every stratum."""
    above = F.col("ROR") > 1
    sides = strata.where(F.col("ROR").isNotNull()).groupBy("drug", "reaction_pt").agg(
        F.count(F.lit(1)).alias("strata"), F.count_if(above).alias("above")
    )
    total = overall.where(F.col("ROR").isNotNull()).select("drug", "reaction_pt", F.col("ROR").alias("ror_overall"))
    flips = ((F.col("ror_overall") > 1) & (F.col("above") == 0)) | ((F.col("ror_overall") <= 1) & (F.col("above") == F.col("strata")))
    return sides.join(total, ["drug", "reaction_pt"]).select(
        "drug", "reaction_pt", "strata", "above", round4(F.col("ror_overall")).alias("ror_overall"), flips.alias("reversed")
    )


def reporter_mix(baskets: DataFrame, qualification: str) -> DataFrame:
    """Share of each reporter qualification per pair."""
    rows = B.report_pairs(B.eligible(baskets), qualification).groupBy("drug", "reaction_pt", qualification).agg(F.count(F.lit(1)).alias("reports"))
    totals = rows.groupBy("drug", "reaction_pt").agg(F.sum("reports").alias("_all"))
    return rows.join(totals, ["drug", "reaction_pt"]).withColumn("share", round4(F.col("reports") / F.col("_all"))).drop("_all")


def interaction_statistic(baskets: DataFrame, gold: DataFrame) -> DataFrame:
    """EXPERIMENTAL: observed joint reports of two drugs with a reaction against a multiplicative baseline.

    Meant for gold pairs ``(a, b, expect)`` only; it failed its known answers in the
    method it comes from and must not be shown as evidence of an interaction.
    ``omega`` is log2((observed + 0.5) / (expected + 0.5)), expected being
    n_ab * r_a * r_b / r_0 with the background rate r_0.
    """
    ok = B.eligible(baskets)
    wanted = gold.select("a", "b", F.upper("expect").alias("expect")).distinct()
    named = B.report_drug(ok)
    both = (
        named.withColumnRenamed("drug", "a").join(wanted, "a")
        .join(named.withColumnRenamed("drug", "b"), ["report_id", "b"])
        .join(ok.select("report_id", "reactions"), "report_id")
        .groupBy("a", "b", "expect")
        .agg(F.count(F.lit(1)).alias("n_ab"), F.count_if(F.array_contains("reactions", F.col("expect"))).alias("observed"))
    )
    cells = C.contingency(ok)
    rate = lambda side: cells.select(
        F.col("drug").alias(side), F.col("reaction_pt").alias("expect"), (F.col("a") / (F.col("a") + F.col("b"))).alias(f"_r_{side}"),
        *([((F.col("a") + F.col("c")) / F.col("N")).alias("_r0")] if side == "a" else []),
    )
    out = both.join(rate("a"), ["a", "expect"], "left").join(rate("b"), ["b", "expect"], "left")
    expected = F.col("n_ab") * F.col("_r_a") * F.col("_r_b") / F.col("_r0")
    omega = F.log2((F.col("observed") + 0.5) / (expected + 0.5))
    return out.select("a", "b", "expect", "n_ab", "observed", round4(expected).alias("expected_joint"), round4(omega).alias("omega"))
