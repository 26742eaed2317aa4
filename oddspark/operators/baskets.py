"""Reports as baskets: one row per report with its drugs and its reactions.

The unit of every count is the report, so all counting starts from
``(report_id, drugs: array<string>, reactions: array<string>)`` with distinct,
non-null entries. A basket holds at most the catalogue of drugs and the
vocabulary of reactions, however many rows a report has: repeated rows are
combined before the shuffle, so one report holding a large share of the input
arrives as a few small partial sets. The sets are sorted: which member of a basket
comes first decides what a report counts for in the marginals, and a task that
runs again must decide alike.

Building baskets costs one shuffle on the report (none if the source already
nests a report in one row); everything after that is narrow until the small
per-pair counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Spellings of the apostrophe that one reaction may come in.
APOSTROPHES = "'\u2019"


def canonical_reaction(term: Column) -> Column:
    """Upper case, trimmed, empty as NULL; possessives have a caret, as they are stored, for any apostrophe."""
    folded = F.translate(F.upper(F.trim(term)), APOSTROPHES, "^" * len(APOSTROPHES))
    return F.when(folded != "", folded)


def reaction_name(term: str) -> str:
    """A name asked for in the spelling of ``canonical_reaction``."""
    return term.strip(" ").upper().translate(dict.fromkeys(map(ord, APOSTROPHES), "^"))


def from_rows(
    rows: DataFrame,
    drug_col: str = "drug",
    reaction_col: str = "reaction_pt",
    report_col: str = "report_id",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Flattened rows (report x drug x reaction, or either side NULL) to baskets.

    ``carry`` adds further aggregates per report in the same pass, e.g. a date or
    an outcome flag.
    """
    extra = [expr.alias(name) for name, expr in (carry or {}).items()]
    return (
        rows.where(F.col(report_col).isNotNull())
        .groupBy(F.col(report_col).alias("report_id"))
        .agg(
            F.sort_array(F.collect_set(F.col(drug_col))).alias("drugs"),
            F.sort_array(F.collect_set(canonical_reaction(F.col(reaction_col)))).alias("reactions"),
            *extra,
        )
    )


def from_long(report_drug: DataFrame, report_reaction: DataFrame, drug_col: str = "drug") -> DataFrame:
    """Two long tables to baskets in one shuffle instead of two distincts and a join."""
    left = report_drug.select("report_id", F.col(drug_col).alias("drug"), F.lit(None).cast("string").alias("reaction_pt"))
    right = report_reaction.select("report_id", F.lit(None).cast("string").alias("drug"), "reaction_pt")
    return from_rows(left.unionByName(right))


def eligible(baskets: DataFrame) -> DataFrame:
    """Reports with at least one drug and one reaction: the universe of the record path."""
    return baskets.where((F.size("drugs") > 0) & (F.size("reactions") > 0))


def report_drug(baskets: DataFrame) -> DataFrame:
    return baskets.select("report_id", F.explode("drugs").alias("drug"))


def report_reaction(baskets: DataFrame) -> DataFrame:
    return baskets.select("report_id", F.explode("reactions").alias("reaction_pt"))


def report_pairs(baskets: DataFrame, *carry: str) -> DataFrame:
    """Every (report, drug, reaction) once; the crossing stays inside the report's row."""
    return baskets.select("report_id", *carry, F.explode("drugs").alias("drug"), "reactions").select(
        "report_id", *carry, "drug", F.explode("reactions").alias("reaction_pt")
    )


def regroup(baskets: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``groups``: every group with at least one of the report's drugs as a member.

    ``groups(group, member)`` is a dimension. The link table keeps the report's
    partitioning, so joining it back needs no further shuffle of the baskets.
    """
    links = (
        report_drug(baskets)
        .join(groups.select("group", F.col("member").alias("drug")), "drug")
        .groupBy("report_id")
        .agg(F.collect_set("group").alias("groups"))
    )
    none = F.array().cast("array<string>")
    return baskets.join(links, "report_id", "left").withColumn("groups", F.coalesce("groups", none))
