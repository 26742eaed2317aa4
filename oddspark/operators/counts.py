"""Report counts: totals, marginals, cells and 2x2 tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddspark.operators import baskets as B


def count_reports(baskets: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Reports matching each named predicate, all in one pass.

    Class membership is ``F.array_contains("drugs", name)`` (exact member, never a
    phrase), reactions likewise; combine with ``&`` and ``|``.
    """
    names = list(predicates)
    row = baskets.agg(*[F.count_if(predicates[n]).alias(f"p{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(f"p{i}").alias("reports")) for i, n in enumerate(names)])
    return row.select(F.inline(pairs))


def value_counts(baskets: DataFrame, field: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Reports per value of an array or scalar field under a predicate, most frequent first."""
    rows = baskets if where is None else baskets.where(where)
    is_array = dict(rows.dtypes)[field].startswith("array")
    value = F.explode(field) if is_array else F.col(field)
    out = rows.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("reports"))
    out = out.orderBy(F.desc("reports"), "value")
    return out if limit is None else out.limit(limit)


def drug_totals(baskets: DataFrame) -> DataFrame:
    return B.report_drug(baskets).groupBy("drug").agg(F.count(F.lit(1)).alias("reports"))


def reaction_totals(baskets: DataFrame) -> DataFrame:
    return B.report_reaction(baskets).groupBy("reaction_pt").agg(F.count(F.lit(1)).alias("reports"))


def pair_counts(baskets: DataFrame, drugs: str = "drugs", by: tuple[str, ...] = ()) -> DataFrame:
    """Cells from one pass over the reports, with what the marginals need, for each value of the columns ``by``.

    ``a`` counts the reports of a pair. ``heads_drug`` counts those in which the
    drug is the first of its report, so summed over drugs it counts every report of
    a reaction once; ``heads_reaction`` likewise for a drug, ``heads_both`` for the
    universe. Both marginals and N therefore come from the small cell table and the
    reports are read, exploded and shuffled only once. Counts combine before the
    shuffle, so what moves is one row per distinct pair and map task.

    The keys are made non-nullable so that no join infers a null check below the
    aggregation, and the final condition (true for every row) keeps the four counts
    together under column pruning: all branches of ``contingency`` then plan the
    same aggregation and share one exchange.
    """
    rows = baskets.select(*by, F.posexplode(drugs).alias("_d", "drug"), "reactions").select(
        *by, "_d", "drug", F.posexplode("reactions").alias("_r", "reaction_pt")
    )
    first_drug, first_reaction = F.col("_d") == 0, F.col("_r") == 0
    keys = [F.coalesce(k, F.lit("")).alias(k) for k in ("drug", "reaction_pt")]
    counts = rows.groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("a"),
        F.count_if(first_drug).alias("heads_drug"),
        F.count_if(first_reaction).alias("heads_reaction"),
        F.count_if(first_drug & first_reaction).alias("heads_both"),
    )
    return counts.where(F.greatest("heads_drug", "heads_reaction", "heads_both") <= F.col("a"))


def united(cells: DataFrame) -> DataFrame:
    """The cells of all reports from those of groups of reports (``pair_counts`` with ``by``)."""
    return cells.groupBy("drug", "reaction_pt").agg(*[F.sum(c).alias(c) for c in ("a", "heads_drug", "heads_reaction", "heads_both")])


def drug_margin(cells: DataFrame) -> DataFrame:
    return cells.groupBy("drug").agg(F.sum("heads_reaction").alias("n_drug"))


def reaction_margin(cells: DataFrame) -> DataFrame:
    return cells.groupBy("reaction_pt").agg(F.sum("heads_drug").alias("n_reaction"))


def universe(cells: DataFrame) -> Column:
    """Number of reports as a scalar subquery; 0 if there are none."""
    return cells.agg(F.coalesce(F.sum("heads_both"), F.lit(0)).alias("n")).select("n").scalar()


def tables(cells: DataFrame, by_drug: DataFrame, by_reaction: DataFrame, total: Column) -> DataFrame:
    """2x2 tables from cells and marginals."""
    b = F.col("n_drug") - F.col("a")
    c = F.col("n_reaction") - F.col("a")
    return (
        cells.select("drug", "reaction_pt", "a")
        .join(by_drug, "drug")
        .join(by_reaction, "reaction_pt")
        .withColumn("N", total)
        .select("drug", "reaction_pt", "a", b.alias("b"), c.alias("c"), (F.col("N") - F.col("a") - b - c).alias("d"), "N")
    )


def contingency(
    baskets: DataFrame,
    drug_filter: str | list[str] | None = None,
    reaction_filter: str | list[str] | None = None,
) -> DataFrame:
    """``drug, reaction_pt, a, b, c, d, N`` for every pair with at least one report.

    Filters act on the pair side only; the marginals always come from all reports.
    Reports must have at least one drug and one reaction (``baskets.eligible``).
    """
    counts = pair_counts(baskets)
    cells = counts
    for name, wanted in (("drug", drug_filter), ("reaction_pt", reaction_filter)):
        if wanted is not None:
            values = [wanted] if isinstance(wanted, str) else list(wanted)
            cells = cells.where(F.col(name).isin([B.reaction_name(v) for v in values] if name == "reaction_pt" else values))
    return tables(cells, drug_margin(counts), reaction_margin(counts), universe(counts))


def contingency_one(baskets: DataFrame, drug: str, reaction: str) -> DataFrame:
    """One ad-hoc pair from a single conditional aggregate; b, c, d never negative."""
    has_drug = F.array_contains("drugs", drug)
    has_reaction = F.array_contains("reactions", B.reaction_name(reaction))
    row = baskets.agg(
        F.count_if(has_drug & has_reaction).alias("a"),
        F.count_if(has_drug).alias("ab"),
        F.count_if(has_reaction).alias("ac"),
        F.count(F.lit(1)).alias("N"),
    )
    zero = F.lit(0).cast("long")
    return (
        row.withColumns({"b": F.greatest(F.col("ab") - F.col("a"), zero), "c": F.greatest(F.col("ac") - F.col("a"), zero)})
        .withColumn("d", F.greatest(F.col("N") - F.col("a") - F.col("b") - F.col("c"), zero))
        .select(F.lit(drug).alias("drug"), F.lit(B.reaction_name(reaction)).alias("reaction_pt"), "a", "b", "c", "d", "N")
    )


def designated_counts(baskets: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact report count of each listed event per drug."""
    return (
        B.report_pairs(baskets)
        .join(terms.select("reaction_pt").distinct(), "reaction_pt", "left_semi")
        .groupBy("drug", "reaction_pt")
        .agg(F.count(F.lit(1)).alias("a"))
    )


def candidates(cells: DataFrame, designated: DataFrame | None, max_terms: int) -> DataFrame:
    """Per drug the ``max_terms`` most reported reactions plus every designated event seen with it.

    Adds ``dme`` and ``freq_rank`` (NULL if the term is in only as a designated
    event). The rank filter is applied locally before the shuffle, so a drug with
    very many pairs sends at most ``max_terms`` rows per task.
    """
    by_count = Window.partitionBy("drug").orderBy(F.desc("a"), "reaction_pt")
    top = (
        cells.withColumn("freq_rank", F.row_number().over(by_count))
        .where(F.col("freq_rank") <= max_terms)
    )
    if designated is None:
        return top.withColumn("dme", F.lit(False))
    terms = designated.select("reaction_pt").distinct().withColumn("_listed", F.lit(True))
    ranked = top.join(terms, "reaction_pt", "left").withColumn("dme", F.coalesce("_listed", F.lit(False))).drop("_listed")
    listed = (
        cells.join(terms.drop("_listed"), "reaction_pt", "left_semi")
        .join(top.select("drug", "reaction_pt"), ["drug", "reaction_pt"], "left_anti")
        .withColumns({"freq_rank": F.lit(None).cast("int"), "dme": F.lit(True)})
    )
    return ranked.unionByName(listed)


def flag_designated(cells: DataFrame, designated: DataFrame | None) -> DataFrame:
    """Every pair, with ``dme`` telling whether its reaction is on the list."""
    if designated is None:
        return cells.withColumn("dme", F.lit(False))
    terms = designated.select("reaction_pt").distinct().withColumn("_listed", F.lit(True))
    return cells.join(terms, "reaction_pt", "left").withColumn("dme", F.coalesce("_listed", F.lit(False))).drop("_listed")


def top_per_group(df: DataFrame, group: str, n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in the given order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)
