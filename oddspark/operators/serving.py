"""Questions asked of the scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark import constants as K
from oddspark.functions import display as D
from oddspark.functions import text as X
from oddspark.operators.baskets import reaction_name
from oddspark.operators.counts import top_per_group

STRONG = ("strong",)


def _evidence() -> list[Column]:
    return [F.desc_nulls_last("IC025"), F.asc("reaction_pt")]


def catalogue(scored: DataFrame, aliases: DataFrame, tiers: tuple = STRONG, brands: int | None = None) -> DataFrame:
    """Per drug: report total, scored reactions, strong reactions and its other names (all, or the first ``brands``)."""
    other = aliases.where(F.col("alias") != F.lower("drug")).distinct()
    shown = other if brands is None else top_per_group(other, "drug", brands, F.asc("alias"))
    few = shown.groupBy("drug").agg(
        F.array_join(F.sort_array(F.collect_list("alias")), ", ").alias("brands")
    )
    facts = scored.groupBy("drug").agg(
        F.max(F.col("a") + F.col("b")).alias("reports"), F.count(F.lit(1)).alias("reactions"),
        F.count_if(F.col("tier").isin(*tiers)).alias("strong"),
    )
    return facts.join(few, "drug", "left").withColumn("brands", F.coalesce("brands", F.lit(""))).orderBy(F.desc("reports"), "drug")


def reaction_index(scored: DataFrame, tiers: tuple = STRONG) -> DataFrame:
    """Per reaction: drugs it is scored with, report total, strong drugs; commonest first."""
    return (
        scored.where("reaction_pt != ''").groupBy("reaction_pt")
        .agg(
            F.count(F.lit(1)).alias("drugs"), F.max(F.col("a") + F.col("c")).alias("reports"),
            F.count_if(F.col("tier").isin(*tiers)).alias("strong"),
        )
        .select(
            "reaction_pt", X.display_term(F.col("reaction_pt")).alias("term"), X.reaction_key(F.col("reaction_pt")).alias("key"),
            "drugs", "reports", "strong",
        )
        .orderBy(F.desc("reports"), "term")
    )


def reaction_options(index: DataFrame, limit: int = 300) -> DataFrame:
    return index.orderBy(F.desc("reports"), "term").limit(limit)


def most_widespread(index: DataFrame, limit: int = 2) -> DataFrame:
    return index.orderBy(F.desc("drugs"), "term").limit(limit)


def corpus_scale(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_distinct("drug").alias("drugs"), F.count_distinct("reaction_pt").alias("reactions"), F.count(F.lit(1)).alias("pairs")
    )


def term_specificity(scored: DataFrame) -> DataFrame:
    """Share of the scored drugs a term is reported with, and how little that says."""
    total = scored.agg(F.count_distinct("drug").alias("n")).select("n").scalar()
    share = F.col("drugs") / F.col("total_drugs")
    band = F.when(share >= K.SPECIFICITY_COMMON, "common").when(share >= K.SPECIFICITY_BROAD, "broad").otherwise("narrow")
    per_term = scored.groupBy("reaction_pt").agg(F.count_distinct("drug").alias("drugs"))
    return per_term.withColumn("total_drugs", total).withColumns({"share": share, "band": band})


def strong_rows(scored: DataFrame, tiers: tuple = STRONG, clean: bool = False) -> DataFrame:
    """Diagnosed rows of the wanted tiers; ``clean`` also drops indication-confounded ones."""
    rows = scored.where(F.coalesce("diagnosed", F.lit(False)) & F.col("tier").isin(*tiers))
    return rows.where(~F.coalesce("indication_overlap", F.lit(False))) if clean else rows


def top_rows(rows: DataFrame, n: int) -> DataFrame:
    return top_per_group(rows, "drug", n, *_evidence())


def tracked_top(scored: DataFrame, tracked: DataFrame, tiers: tuple = STRONG, n: int = K.TRACKED_ROWS) -> DataFrame:
    """Each user's tracked drugs with their best diagnosed rows.

    The rows per drug are few, so the join grows with the tracked list only.
    """
    best = top_rows(strong_rows(scored, tiers), n).select("drug", "reaction_pt", "IC025", "a", "rank")
    return tracked.select("user_id", "drug").distinct().join(best, "drug")


def compare_two(scored: DataFrame, left: str, right: str) -> DataFrame:
    """Union of two drugs' reactions, ranked by the higher side."""
    if left == right:
        raise ValueError(f"both names resolve to {left}")
    side = lambda name, tag: scored.where(F.col("drug") == name).select(
        "reaction_pt", *[F.col(c).alias(f"{tag}_{c}") for c in ("a", "ROR", "IC025", "tier")],
        (F.col("diagnosed") if "diagnosed" in scored.columns else F.lit(False)).alias(f"{tag}_diagnosed"), F.lit(True).alias(f"_{tag}"),
    )
    both = side(left, "left").join(side(right, "right"), "reaction_pt", "full_outer")
    only = F.when(F.col("_right").isNull(), "left").when(F.col("_left").isNull(), "right")
    no = F.lit(False)
    return (
        both.withColumns(
            {
                "only": only,
                "rank_score": F.greatest("left_IC025", "right_IC025"),
                "diagnosed": F.coalesce("left_diagnosed", no) | F.coalesce("right_diagnosed", no),
            }
        )
        .drop("_left", "_right", "left_diagnosed", "right_diagnosed")
        .orderBy(F.desc_nulls_last("rank_score"), "reaction_pt")
    )


def list_panels(scored: DataFrame, drugs: list[str], tiers: tuple = STRONG, n: int = K.LIST_PER_DRUG) -> DataFrame:
    """Best rows of each listed drug, with the drug's report total and number of reactions."""
    listed = scored.where(F.col("drug").isin(*drugs))
    sizes = listed.groupBy("drug").agg(F.max(F.col("a") + F.col("b")).alias("total_reports"), F.count(F.lit(1)).alias("reactions"))
    best = top_rows(listed.where(F.col("tier").isin(*tiers)), n).select("drug", "reaction_pt", "a", "ROR", "IC025", "rank")
    return sizes.join(best, "drug", "left")


def shared_reactions(scored: DataFrame, drugs: list[str], tiers: tuple = STRONG, limit: int = K.LIST_SHARED_ROWS) -> DataFrame:
    """Reactions of the wanted tiers for at least two listed drugs, one score column per drug."""
    rows = scored.where(F.col("drug").isin(*drugs) & F.col("tier").isin(*tiers))
    cell = lambda d: F.max(F.when(F.col("drug") == d, F.col("IC025"))).alias(d)
    return (
        rows.groupBy("reaction_pt")
        .agg(F.count(F.lit(1)).alias("shared_by"), F.max("IC025").alias("top"), *[cell(d) for d in drugs])
        .where("shared_by >= 2")
        .orderBy(F.desc("shared_by"), F.desc_nulls_last("top"), "reaction_pt")
        .limit(limit)
    )


def worksheet_grid(spark: SparkSession, scored: DataFrame, medicines: list[str], symptoms: list[str]) -> DataFrame:
    """Every symptom against every medicine in entry order; cells without a pair are kept."""
    symptoms = [reaction_name(s) for s in symptoms]
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    grid = (
        spark.range(1)
        .select(F.posexplode(listed(symptoms)).alias("symptom_no", "reaction_pt"))
        .select("symptom_no", "reaction_pt", F.posexplode(listed(medicines)).alias("medicine_no", "drug"))
    )
    wanted = scored.where(F.col("reaction_pt").isin(*symptoms))
    have = set(scored.columns)
    keep = ["drug", "reaction_pt", "a", "ROR", "IC025", "tier"] + [
        c for c in ("label_found", "labelled", "boxed_warning", "indication_overlap", "notoriety_spike", "active_comparator_shrinkage") if c in have
    ]
    total = scored.agg(F.count_distinct("drug").alias("n")).select("n").scalar()
    spread = wanted.groupBy("reaction_pt").agg(
        F.count_distinct("drug").alias("reported_for"), F.max(F.col("a") + F.col("c")).alias("reports")
    )
    cells = grid.join(spread, "reaction_pt", "left").join(
        wanted.where(F.col("drug").isin(*medicines)).select(*keep), ["drug", "reaction_pt"], "left"
    )
    zero = F.lit(0).cast("long")
    out = cells.withColumns(
        {
            "reported_for": F.coalesce("reported_for", zero), "reports": F.coalesce("reports", zero),
            "total_drugs": total, "in_table": F.col("a").isNotNull(),
        }
    )
    if "labelled" in have:
        state = D.label_state(F.col("label_found"), F.col("labelled"), F.col("boxed_warning"))
        term = X.display_term(F.col("reaction_pt"))
        out = out.withColumn("label_kind", F.when(F.col("in_table"), state))
        out = out.withColumn("label_fact", F.when(F.col("in_table"), D.label_sentence(F.col("label_kind"), F.col("drug"), term)))
    return out.orderBy("symptom_no", "medicine_no")


def profile(scored: DataFrame) -> DataFrame:
    """Scored rows in display form, checked rows before unchecked ones."""
    return D.profile_columns(scored).orderBy(F.desc("diagnosed"), *_evidence())


def sort_by(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """User-chosen order with a stable tie-break."""
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return rows.orderBy(key, "drug", "reaction_pt")
