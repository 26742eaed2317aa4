"""Pair scoring: the record path, the count path and single pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddspark.functions import stats as S
from oddspark.operators import baskets as B
from oddspark.operators import counts as C

SCORED = ["drug", "reaction_pt", "a", "b", "c", "d", "N", *S.MEASURES, "signal", "tier"]


def by_evidence() -> list:
    return [F.desc_nulls_last("IC025"), F.asc("drug"), F.asc("reaction_pt")]


def measure(tables: DataFrame) -> DataFrame:
    """All measures, the gate and the tier for 2x2 rows, undefined ratios as NULL."""
    return S.with_gates(S.with_bcpnn(S.with_ratios(tables)))


def score(
    baskets: DataFrame,
    drug_filter: str | list[str] | None = None,
    reaction_filter: str | list[str] | None = None,
    ordered: bool = True,
    rounded: bool = True,
) -> DataFrame:
    """Record path: every pair of every eligible report, N = eligible reports."""
    out = measure(C.contingency(B.eligible(baskets), drug_filter, reaction_filter)).select(*SCORED)
    if rounded:
        out = S.round_measures(out)
    return out.orderBy(*by_evidence()) if ordered else out


def score_cells(cells: DataFrame) -> DataFrame:
    """As ``score``, neither ordered nor rounded, from the cells of ``counts.pair_counts``."""
    return measure(C.tables(cells, C.drug_margin(cells), C.reaction_margin(cells), C.universe(cells))).select(*SCORED)


def score_counts(
    baskets: DataFrame,
    stoplist: DataFrame | None = None,
    designated: DataFrame | None = None,
    max_terms: int | None = None,
    ordered: bool = True,
    rounded: bool = True,
) -> DataFrame:
    """Count path: all pairs, or the candidates per drug if ``max_terms`` is given; stoplist removed, rows with an empty cell dropped.

    N is counted from the data instead of being a constant, so a refresh cannot
    skew d.
    """
    cells = C.contingency(B.eligible(baskets))
    picked = C.flag_designated(cells, designated) if max_terms is None else C.candidates(cells, designated, max_terms).drop("freq_rank")
    if stoplist is not None:
        picked = picked.join(stoplist.select("reaction_pt"), "reaction_pt", "left_anti")
    full = picked.where((F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0))
    out = S.with_gates(S.with_bcpnn(S.with_single_ratios(full))).select(*SCORED, "dme")
    if rounded:
        out = S.round_measures(out)
    return out.orderBy(*by_evidence()) if ordered else out


def score_one(baskets: DataFrame, drug: str, reaction: str) -> DataFrame:
    """One ad-hoc pair against the whole database."""
    one = S.with_bcpnn(S.with_single_ror(C.contingency_one(baskets, drug, reaction)))
    return S.round_measures(
        one.select("drug", "reaction_pt", "a", "b", "c", "d", "N", "ROR", "ROR_lower", "ROR_upper", "IC", "IC025", "IC975")
    )


def incremental(baskets: DataFrame, finished: DataFrame) -> DataFrame:
    """Score only drugs without rows in ``finished``; marginals still see all reports."""
    cells = C.contingency(B.eligible(baskets)).join(finished.select("drug").distinct(), "drug", "left_anti")
    return S.round_measures(measure(cells).select(*SCORED))


def merge(frames: list[DataFrame], load_order: str = "_load") -> DataFrame:
    """Stack scored tables, later ones winning on (drug, reaction)."""
    stacked = None
    for i, frame in enumerate(frames):
        part = frame.withColumn(load_order, F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    latest = Window.partitionBy("drug", "reaction_pt").orderBy(F.desc(load_order))
    return (
        stacked.withColumn("_rn", F.row_number().over(latest))
        .where(F.col("_rn") == 1)
        .drop("_rn", load_order)
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Pairs, strong pairs, screening flags and designated events per drug."""
    dme = F.count_if("dme") if "dme" in scored.columns else F.lit(0).cast("long")
    return scored.groupBy("drug").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("tier") == "strong").alias("strong"),
        F.count_if(F.col("tier") != "none").alias("tiered"),
        F.count_if("signal").alias("signals"),
        dme.alias("designated"),
    )
