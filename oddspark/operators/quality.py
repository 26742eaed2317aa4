"""Known-answer controls, invariants, expectations and census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark import constants as K
from oddspark.functions import stats as S
from oddspark.functions.special import round4
from oddspark.operators import baskets as B
from oddspark.operators import counts as C


def run_controls(scored: DataFrame, controls: DataFrame) -> DataFrame:
    """One row per control with ``passed``.

    ``controls(name, kind, drug, reaction_pt, check, ror_min, ror_max)``. Positive
    checks need the gate and a ratio in range or above the bound; ``no_signal``
    asserts on IC025, not on the gate; ``absent`` needs the term to be missing.
    """
    rows = scored.select("drug", "reaction_pt", "a", "ROR", "ROR_lower", "ROR_upper", "IC025")
    joined = controls.join(rows, ["drug", "reaction_pt"], "left")
    gate = F.coalesce((F.col("a") >= K.MIN_REPORTS) & (F.col("ROR_lower") > 1.0), F.lit(False))
    check, ror = F.col("check"), F.col("ROR")
    passed = (
        F.when(check == "ROR_in_range", gate & F.coalesce(ror.between(F.col("ror_min"), F.col("ror_max")), F.lit(False)))
        .when(check == "ROR_above", gate & F.coalesce(ror >= F.col("ror_min"), F.lit(False)))
        .when(check == "no_signal", ~F.coalesce(F.col("IC025") > K.TIER_MODERATE, F.lit(False)))
        .when(check == "absent", F.col("a").isNull())
        .otherwise(False)
    )
    return joined.select("name", "kind", "drug", "reaction_pt", "check", "a", "ROR", "ROR_lower", "ROR_upper", "IC025", passed.alias("passed"))


def control_summary(results: DataFrame) -> DataFrame:
    core = F.when(F.col("kind") != "time_stability", F.col("passed"))
    return results.agg(
        F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_total"), F.coalesce(F.bool_and(core), F.lit(True)).alias("passed")
    )


def _single_ror(baskets: DataFrame) -> DataFrame:
    return S.with_single_ror(C.contingency(B.eligible(baskets))).select("drug", "reaction_pt", "a", "ROR")


def time_stability(baskets: DataFrame, first: str, last: str) -> DataFrame:
    """Does the ratio in a date window (with its own N) fall on the same side of 1 as the full one?"""
    window = F.col("receipt_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    full = _single_ror(baskets).select("drug", "reaction_pt", F.col("ROR").alias("ror_full"))
    recent = _single_ror(baskets.where(window)).select(
        "drug", "reaction_pt", F.col("a").alias("a_recent"), F.col("ROR").alias("ror_recent")
    )
    same = F.coalesce((F.col("ror_recent") > 1) == (F.col("ror_full") > 1), F.lit(True))
    return full.join(recent, ["drug", "reaction_pt"], "left").select(
        "drug", "reaction_pt", F.coalesce("a_recent", F.lit(0)).alias("a_recent"),
        round4(F.col("ror_recent")).alias("ROR_recent"), round4(F.col("ror_full")).alias("ROR_full"), same.alias("passed"),
    )


def expectations(scored: DataFrame, anchor: tuple[str, str], low: float, high: float, least_rows: int = 1000) -> DataFrame:
    """Table-level expectations: size, share of diagnosed rows, anchor ratio."""
    here = (F.col("drug") == anchor[0]) & (F.col("reaction_pt") == anchor[1])
    diagnosed = F.coalesce("diagnosed", F.lit(False)) if "diagnosed" in scored.columns else F.lit(False)
    row = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~diagnosed).alias("undiagnosed"), F.max(F.when(here, F.col("ROR"))).alias("anchor")
    )
    share = F.coalesce(F.try_divide((F.col("n") - F.col("undiagnosed")).cast("double"), F.col("n").cast("double")), F.lit(0.0))
    rule = lambda name, value, ok: F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return row.select(
        F.inline(
            F.array(
                rule("rows", F.col("n"), F.col("n") > least_rows),
                rule("diagnosed_share", round4(share), share >= 0.99),
                rule("undiagnosed_rows", F.col("undiagnosed"), F.col("undiagnosed") == 0),
                rule("anchor_ror", F.col("anchor"), (F.col("anchor") > low) & (F.col("anchor") < high)),
            )
        )
    )


def invariant_rules(columns: list[str]) -> dict[str, Column]:
    """Row rules that must hold wherever their columns are not NULL."""
    have = set(columns)
    c = F.col
    rules = {
        "cells_sum_to_n": c("a") + c("b") + c("c") + c("d") == c("N"),
        "cells_not_negative": F.least("a", "b", "c", "d") >= 0,
        "ic_in_interval": (c("IC025") <= c("IC")) & (c("IC") <= c("IC975")),
        "ror_in_interval": (c("ROR_lower") <= c("ROR")) & (c("ROR") <= c("ROR_upper")),
        "tier_matches_band": c("tier") == S.tier(c("IC025"), c("a")),
    }
    if {"EB05", "EBGM", "EB95"} <= have:
        rules["eb_in_interval"] = (c("EB05") <= c("EBGM")) & (c("EBGM") <= c("EB95"))
    if set(K.OUTCOMES) <= have:
        rules["outcomes_within_a"] = F.greatest(*K.OUTCOMES) <= c("a")
    return rules


def invariants(scored: DataFrame) -> DataFrame:
    """``rule, violations`` plus key uniqueness, computed on unrounded measures."""
    rules = invariant_rules(scored.columns)
    keys = F.count(F.lit(1)) - F.count_distinct("drug", "reaction_pt")
    row = scored.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()], keys.alias("duplicate_keys")
    )
    names = [*rules, "duplicate_keys"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names])))


def field_census(table: DataFrame) -> DataFrame:
    """Rows, NULLs and NULL rate of every column in one pass."""
    row = table.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in table.columns])
    entry = lambda c: F.struct(
        F.lit(c).alias("field"), F.col("_rows").alias("rows"), (F.col("_rows") - F.col(c)).alias("nulls"),
        round4(F.try_divide((F.col("_rows") - F.col(c)).cast("double"), F.col("_rows").cast("double"))).alias("null_rate"),
    )
    return row.select(F.inline(F.array(*[entry(c) for c in table.columns])))


def dead_classes(declared: DataFrame, totals: DataFrame) -> DataFrame:
    """Declared class strings without any report: ``declared(epc, referenced_by)``."""
    return declared.join(totals.select(F.col("drug").alias("epc")), "epc", "left_anti")


def orphan_classes(classes: DataFrame, molecules: DataFrame) -> DataFrame:
    """Classes with neither a class string nor molecules can never be scored."""
    return classes.where(F.col("epc").isNull()).join(molecules.select("class").distinct(), "class", "left_anti").select("class")


def unresolved(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")
