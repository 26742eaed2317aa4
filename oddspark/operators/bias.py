"""Reasons for doubt: reporting bursts, indication overlap and comparator groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddspark import constants as K
from oddspark.functions import stats as S
from oddspark.functions import text as X
from oddspark.functions.special import round4
from oddspark.operators import baskets as B
from oddspark.operators import counts as C

# --- reporting over time ---------------------------------------------------------


def pair_trend(baskets: DataFrame) -> DataFrame:
    """``drug, reaction_pt, month, n``: reports per pair and calendar month (sparse)."""
    dated = baskets.withColumn("month", F.trunc("receipt_date", "MM").cast("date")).where("month is not null")
    return (
        B.report_pairs(B.eligible(dated), "month")
        .groupBy("drug", "reaction_pt", "month")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def month_from_text(stamp: Column) -> Column:
    """First day of the month of a YYYYMMDD (or longer) string, NULL if impossible."""
    ym = F.substring(stamp, 1, 6)
    return F.when(F.length(stamp) >= 6, F.to_date(F.try_to_timestamp(F.concat(ym, F.lit("01")), F.lit("yyyyMMdd"))))


def plausible_month(month: Column, last_year: int | None = None) -> Column:
    """Months from the first year on, and up to ``last_year`` if the caller knows the year of the extract."""
    first = F.year(month) >= K.TREND_FIRST_YEAR
    return first if last_year is None else first & (F.year(month) <= last_year)


def burstiness(trend: DataFrame, last_year: int | None = None, threshold: float = K.SPIKE_SHARE) -> DataFrame:
    """Share of the busiest month; impossible months are dropped first and counted."""
    ok = plausible_month(F.col("month"), last_year)
    kept = F.when(ok, F.col("n"))
    return (
        trend.groupBy("drug", "reaction_pt")
        .agg(
            F.coalesce(F.sum(kept), F.lit(0)).alias("reports"),
            F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("dropped"),
            F.max(kept).alias("_top"),
        )
        .withColumn("_share", F.coalesce(F.try_divide(F.col("_top").cast("double"), F.col("reports").cast("double")), F.lit(0.0)))
        .select(
            "drug", "reaction_pt", "reports", "dropped",
            round4(F.col("_share")).alias("burstiness"),
            (F.col("_share") > threshold).alias("notoriety_spike"),
        )
    )


def dense_trend(trend: DataFrame, last_year: int | None = None) -> DataFrame:
    """One row per month between a pair's first and last report, gaps filled with 0."""
    ok = trend.where(plausible_month(F.col("month"), last_year))
    span = ok.groupBy("drug", "reaction_pt").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select("drug", "reaction_pt", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return months.join(ok, ["drug", "reaction_pt", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rollup_trend(trend: DataFrame, last_year: int | None = None) -> DataFrame:
    """Plot series per pair: months, quarters beyond 40 points, years beyond 116 quarters.

    ``bucket`` is the bucket's first month. Unit and zero filling follow from the
    pair's first and last month, so the dense monthly series is never built.
    """
    ok = trend.where(plausible_month(F.col("month"), last_year))
    index = F.year("month") * 12 + F.month("month") - 1
    span = ok.groupBy("drug", "reaction_pt").agg(F.min(index).alias("lo"), F.max(index).alias("hi"))
    months = F.col("hi") - F.col("lo") + 1
    quarters = F.floor(F.col("hi") / 3) - F.floor(F.col("lo") / 3) + 1
    width = F.when(months <= K.TREND_MAX_POINTS, 1).when(quarters <= K.TREND_MAX_QUARTERS, 3).otherwise(12)
    span = span.withColumn("width", width)
    slot = lambda col: F.floor(F.col(col) / F.col("width")).cast("int")
    grid = span.select("drug", "reaction_pt", "width", F.explode(F.sequence(slot("lo"), slot("hi"))).alias("slot"))
    sums = (
        ok.select("drug", "reaction_pt", index.alias("index"), "n")
        .join(span.select("drug", "reaction_pt", "width"), ["drug", "reaction_pt"])
        .groupBy("drug", "reaction_pt", slot("index").alias("slot"))
        .agg(F.sum("n").alias("n"))
    )
    first = F.col("slot") * F.col("width")
    return grid.join(sums, ["drug", "reaction_pt", "slot"], "left").select(
        "drug", "reaction_pt",
        F.when(F.col("width") == 1, "monthly").when(F.col("width") == 3, "quarterly").otherwise("yearly").alias("unit"),
        F.make_date(F.floor(first / 12).cast("int"), F.pmod(first, F.lit(12)) + 1, F.lit(1)).alias("bucket"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def series_summary(series: DataFrame, bursts: DataFrame) -> DataFrame:
    """First, last, total, unit and peak of a rolled-up series, with a caption."""
    peak = F.struct(F.col("n"), (-F.unix_date("bucket")).alias("early"))
    facts = series.groupBy("drug", "reaction_pt", "unit").agg(
        F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("points"), F.max_by("bucket", peak).alias("peak"), F.max("n").alias("peak_n"),
    )
    label = lambda c: F.when(F.col("unit") == "yearly", F.date_format(c, "yyyy")).otherwise(F.date_format(c, "yyyy-MM"))
    spike = F.when(
        F.col("notoriety_spike"),
        F.concat(F.lit("; "), F.rint(F.col("burstiness") * 100).cast("long").cast("string"), F.lit("% in one month")),
    )
    caption = F.concat(
        label("first"), F.lit(" to "), label("last"), F.lit(", "), F.col("total").cast("string"),
        F.lit(" reports, "), F.col("unit"), F.coalesce(spike, F.lit("")),
    )
    return facts.join(bursts.select("drug", "reaction_pt", "burstiness", "notoriety_spike"), ["drug", "reaction_pt"], "left").withColumn(
        "caption", caption
    )


def trend_map(trend: DataFrame) -> DataFrame:
    """Trend as one sorted map per pair, the stored form (bounded by the months of the extract)."""
    entry = F.struct(F.date_format("month", "yyyy-MM").alias("m"), F.col("n"))
    return trend.groupBy("drug", "reaction_pt").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("trend"))


# --- indications --------------------------------------------------------------------


def drug_indications(baskets: DataFrame, limit: int | None = None) -> DataFrame:
    """Reports per drug and indication, all of them or the ``limit`` commonest. Spellings are folded first, so none is split."""
    folded = F.array_distinct(F.filter(F.transform("indications", lambda t: F.upper(F.trim(t))), lambda t: t != ""))
    counts = (
        baskets.select(F.explode("drugs").alias("drug"), folded.alias("indications"))
        .select("drug", F.explode("indications").alias("indication"))
        .groupBy("drug", "indication")
        .agg(F.count(F.lit(1)).alias("reports"))
    )
    if limit is None:
        return counts
    return C.top_per_group(counts, "drug", limit, F.desc("reports"), F.asc("indication")).drop("rank")


def indication_overlap(pairs: DataFrame, indications: DataFrame) -> DataFrame:
    """Flag reactions half of whose words occur in one recorded indication of the drug.

    Which reaction resembles which indication does not depend on the drug, so it is
    found once for the distinct names of both, by a join on the word, and then looked
    up for the indications of each drug. Drugs without any indication get False.
    """
    reactions = pairs.select("reaction_pt").distinct().withColumn("_words", X.word_set(F.col("reaction_pt")))
    left = reactions.select("reaction_pt", F.size("_words").alias("_n"), F.explode("_words").alias("_word"))
    right = indications.select("indication").distinct().select("indication", F.explode(X.word_set(F.col("indication"))).alias("_word"))
    alike = (
        left.join(right, "_word")
        .groupBy("reaction_pt", "indication", "_n")
        .agg(F.count(F.lit(1)).alias("_common"))
        .where(F.col("_common") >= F.col("_n") * K.INDICATION_SHARE)
    )
    flagged = (
        indications.select("drug", "indication")
        .join(alike, "indication")
        .select("drug", "reaction_pt")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return (
        pairs.join(flagged, ["drug", "reaction_pt"], "left")
        .withColumn("indication_overlap", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


# --- comparator groups ------------------------------------------------------------------


def comparator_dim(classes: DataFrame, area_members: DataFrame, molecules: DataFrame | None = None) -> DataFrame:
    """``(drug, peer)``: the other classes of the same area.

    ``classes(class, epc, area)``, ``area_members(area, epc)``, optional
    ``molecules(class, molecule)`` which inherit their class's peers. A class
    without its own class string keeps every class of the area; no peers, no rows.
    """
    own = classes.select("class", F.col("epc").alias("own"), "area")
    peers = own.join(area_members.select("area", F.col("epc").alias("peer")).distinct(), "area")
    peers = peers.where(~F.col("peer").eqNullSafe(F.col("own")) & F.col("peer").isNotNull())
    out = peers.select(F.col("class").alias("drug"), "peer")
    if molecules is not None:
        members = molecules.join(peers, "class").select(F.col("molecule").alias("drug"), "peer")
        out = out.unionByName(members)
    return out.distinct()


def _grouped(baskets: DataFrame, dim: DataFrame) -> DataFrame:
    return B.regroup(B.eligible(baskets), dim.select(F.col("drug").alias("group"), F.col("peer").alias("member")))


def comparator_cells(baskets: DataFrame, dim: DataFrame) -> DataFrame:
    """2x2 of the comparator group itself against the whole database.

    A report counts once per group however many peers it names. Reaction totals
    and N come from all reports, also those without any peer.
    """
    cells, base = C.pair_counts(_grouped(baskets, dim), "groups"), C.pair_counts(B.eligible(baskets))
    return C.tables(cells, C.drug_margin(cells), C.reaction_margin(base), C.universe(base))


def active_comparator(baskets: DataFrame, dim: DataFrame) -> DataFrame:
    """Odds ratio of the comparator group (not of the drug) per reaction; rows with an empty cell drop out."""
    cells = comparator_cells(baskets, dim).where((F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0))
    return S.with_single_ror(cells).select(
        "drug", "reaction_pt",
        F.col("a").alias("comparator_a"), F.col("b").alias("comparator_b"),
        F.col("c").alias("comparator_c"), F.col("d").alias("comparator_d"),
        F.col("ROR").alias("active_comparator_ror"),
    )


def attach_active_comparator(pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Add ratio and shrinkage; ``pairs`` must carry the unrounded ROR."""
    ratio = F.col("active_comparator_ror")
    shrink = F.when(F.col("ROR") > 0, (F.col("ROR") - ratio) / F.col("ROR"))
    joined = pairs.join(ratios.select("drug", "reaction_pt", "active_comparator_ror"), ["drug", "reaction_pt"], "left")
    return joined.withColumn("active_comparator_shrinkage", shrink)


def direct_comparator(baskets: DataFrame, dim: DataFrame) -> DataFrame:
    """Textbook comparison: the drug's reports against reports of its peers without the drug."""
    grouped = _grouped(baskets, dim)
    # Reports counted for a group exclude those that name the drug itself.
    only_peers = grouped.withColumn("groups", F.array_except("groups", "drugs"))
    exposed = C.contingency(B.eligible(baskets)).select("drug", "reaction_pt", "a", "b")
    other = C.pair_counts(only_peers, "groups")
    cells = other.select("drug", "reaction_pt", F.col("a").alias("c"))
    totals = C.drug_margin(other).withColumnRenamed("n_drug", "peer_reports")
    zero = F.lit(0).cast("long")
    table = (
        exposed.join(totals, "drug")
        .join(cells, ["drug", "reaction_pt"], "left")
        .withColumn("c", F.coalesce("c", zero))
        .withColumn("d", F.col("peer_reports") - F.col("c"))
        .withColumn("N", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    )
    return S.round_measures(
        S.with_ratios(table).select("drug", "reaction_pt", "a", "b", "c", "d", "N", "ROR", "ROR_lower", "ROR_upper")
    )


# --- orchestration ------------------------------------------------------------------------


def bias_profile(
    scored: DataFrame,
    bursts: DataFrame,
    indications: DataFrame,
    ratios: DataFrame,
    top_n: int | None = None,
) -> DataFrame:
    """Attach the diagnostics to every row, or only to the ``top_n`` rows per drug, with ``diagnosed`` telling which.

    ``scored`` carries unrounded measures. Without a cut no row is ranked and nothing
    of a drug has to meet in one task.
    """
    ranked = scored.withColumn("diagnosed", F.lit(True))
    if top_n is not None:
        order = Window.partitionBy("drug").orderBy(F.desc_nulls_last("IC025"), "reaction_pt")
        ranked = scored.withColumn("diagnosed", F.row_number().over(order) <= top_n)
    full = attach_active_comparator(indication_overlap(ranked, indications), ratios).join(
        bursts.select("drug", "reaction_pt", "burstiness", "notoriety_spike"), ["drug", "reaction_pt"], "left"
    )
    flags = ["burstiness", "notoriety_spike", "indication_overlap", "active_comparator_ror", "active_comparator_shrinkage"]
    shown = full if top_n is None else full.withColumns({c: F.when(F.col("diagnosed"), F.col(c)) for c in flags})
    return shown.select(*scored.columns, "diagnosed", *flags)
