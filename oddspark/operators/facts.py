"""Product facts: approvals, marketing, recalls and shortages matched to molecules by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.functions import text as X
from oddspark.operators.phrases import phrase_matches


def original_approval(submissions: Column) -> Column:
    """Earliest dated, approved original submission (YYYYMMDD); supplements do not count."""
    wanted = F.filter(
        submissions,
        lambda s: (s["submission_type"] == "ORIG") & (s["submission_status"] == "AP")
        & (F.coalesce(s["submission_status_date"], F.lit("")) != ""),
    )
    return F.array_min(F.transform(wanted, lambda s: s["submission_status_date"]))


def molecule_forms(molecules: DataFrame) -> DataFrame:
    """``(molecule, term)``: searchable spellings of at least five characters."""
    return molecules.select("molecule", F.explode(X.name_forms(F.col("molecule"), F.col("variants"))).alias("term")).distinct()


#: Tasks that the rows of one name text are dealt to.
SALTS = 16


def facts_match(records: DataFrame, forms: DataFrame) -> DataFrame:
    """Every record once per molecule its ``haystack`` names, with all its columns.

    Names repeat a lot across records, so the dictionary lookup runs on distinct
    haystacks. Its result is joined back on a digest of the text and a salt taken from
    the record, so neither a long nor a popular name makes a wide or a hot key.
    """
    columns = [c for c in records.columns if c != "haystack"]
    keyed = records.where("haystack != ''").withColumn("_text", F.sha2("haystack", 256))
    texts = keyed.select("_text", "haystack").distinct()
    named = phrase_matches(texts, "haystack", forms.select("term")).join(forms, "term").groupBy("_text").agg(F.collect_set("molecule").alias("_named"))
    dealt = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.select(*columns, "_text", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("_salt"))
    return salted.join(dealt, ["_text", "_salt"]).select(*columns, F.explode("_named").alias("molecule"))


def molecule_baskets(baskets: DataFrame, entries: DataFrame, forms: DataFrame) -> DataFrame:
    """``baskets`` with the molecules that the entries of each report name beside its classes.

    ``entries(report_id, haystack)`` has one row per drug entry, ``forms(molecule, term)`` any spelling.
    A report's entries are cut to its molecules before they meet the baskets; all other columns stay.
    """
    named = facts_match(entries.select("report_id", "haystack"), forms)
    found = named.groupBy("report_id").agg(F.collect_set("molecule").alias("_named"))
    none = F.array().cast("array<string>")
    both = F.sort_array(F.array_union(F.coalesce("drugs", none), F.coalesce("_named", none)))
    joined = baskets.join(found, "report_id", "left")
    # as a one-row generator the members are a barrier for filters, which would unite them again
    named = joined.select(*joined.columns, F.inline(F.array(F.struct(both.alias("_drugs"))))).drop("drugs", "_named")
    return named.withColumnRenamed("_drugs", "drugs").select(*baskets.columns)


def molecule_reports(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct reports per molecule; any variant as a phrase in any name field counts.

    ``products(report_id, haystack)``, ``variants(molecule, term)`` of any length.
    """
    hits = facts_match(products.select("report_id", "haystack"), variants).distinct()
    return hits.groupBy("molecule").agg(F.count(F.lit(1)).alias("reports"))


def parse_stamp(stamp: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(stamp, 1, 8), F.lit("yyyyMMdd")))


def years_marketed(approved: Column, as_of: str) -> Column:
    return F.rint(F.datediff(F.lit(as_of).cast("date"), approved) / 365.25 * 10.0) / 10.0


def approvals(applications: DataFrame, forms: DataFrame) -> DataFrame:
    """``molecule, first_approval, applications`` from ``(record_id, haystack, approval)``."""
    hits = facts_match(applications.where(F.col("approval").isNotNull()), forms)
    return hits.groupBy("molecule").agg(
        parse_stamp(F.min("approval")).alias("first_approval"), F.count(F.lit(1)).alias("applications")
    ).where(F.col("first_approval").isNotNull())


def marketing(products: DataFrame, forms: DataFrame, molecules: DataFrame) -> DataFrame:
    """Listed products per molecule; absence from the directory is the withdrawal signal."""
    hits = facts_match(products, forms).groupBy("molecule").agg(F.count(F.lit(1)).alias("listed_products"))
    out = molecules.select("molecule").join(hits, "molecule", "left").withColumn("listed_products", F.coalesce("listed_products", F.lit(0)))
    return out.withColumn("marketed_now", F.col("listed_products") > 0)


def recalls(records: DataFrame, forms: DataFrame, molecules: DataFrame) -> DataFrame:
    """Open recalls, Class I among them, and the latest one."""
    hits = facts_match(records.where(F.col("status") == "Ongoing"), forms)
    latest = F.struct(F.coalesce("initiated", F.lit("")).alias("initiated"), "classification", "record_id")
    rolled = hits.groupBy("molecule").agg(
        F.count(F.lit(1)).alias("recalls_open"),
        F.count_if(F.col("classification") == "Class I").alias("recalls_class_i"),
        F.max(latest).alias("_latest"),
    )
    zero = F.lit(0)
    return molecules.select("molecule").join(rolled, "molecule", "left").select(
        "molecule", F.coalesce("recalls_open", zero).alias("recalls_open"), F.coalesce("recalls_class_i", zero).alias("recalls_class_i"),
        F.col("_latest.initiated").alias("recall_latest"), F.col("_latest.classification").alias("recall_latest_class"),
    )


def shortages(records: DataFrame, forms: DataFrame) -> DataFrame:
    """First current shortage, otherwise the last planned discontinuation, in file order ``seq``."""
    hits = facts_match(records.where(F.col("status").isin("Current", "To Be Discontinued")), forms)
    current = F.col("status") == "Current"
    rank = F.struct(current.cast("int"), F.when(current, -F.col("seq")).otherwise(F.col("seq")))
    best = hits.groupBy("molecule").agg(F.max_by(F.struct("status", "since"), rank).alias("best"))
    return best.select("molecule", F.col("best.status").alias("shortage_status"), F.col("best.since").alias("shortage_since"))


def class_facts(by_molecule: DataFrame, members: DataFrame, as_of: str) -> DataFrame:
    """Classes inherit the earliest approval and the sum of applications of their members."""
    return (
        members.join(by_molecule.select("molecule", "first_approval", "applications"), "molecule")
        .groupBy(F.col("class").alias("drug"))
        .agg(F.min("first_approval").alias("first_approval"), F.sum("applications").alias("applications"))
        .withColumns({"years_marketed": years_marketed(F.col("first_approval"), as_of), "from_class_members": F.lit(True)})
    )


def drug_facts(
    molecules: DataFrame, members: DataFrame, applications: DataFrame, directory: DataFrame,
    recall_records: DataFrame, shortage_records: DataFrame, as_of: str,
) -> DataFrame:
    """One row per molecule and class with every fact; supply facts exist per molecule only."""
    forms = molecule_forms(molecules)
    approved = approvals(applications, forms)
    base = (
        molecules.select("molecule")
        .join(approved, "molecule", "left")
        .join(marketing(directory, forms, molecules), "molecule")
        .join(recalls(recall_records, forms, molecules), "molecule")
        .join(shortages(shortage_records, forms), "molecule", "left")
        .withColumns({"years_marketed": years_marketed(F.col("first_approval"), as_of), "from_class_members": F.lit(False)})
        .withColumnRenamed("molecule", "drug")
    )
    return base.unionByName(class_facts(approved, members, as_of), allowMissingColumns=True)


def check_known(facts: DataFrame, known: DataFrame, tolerance: int = 1) -> DataFrame:
    """Known approval years and market states against ``facts``.

    ``known(drug, year, marketed)``; a NULL expectation is not checked.
    """
    got = known.join(facts.select("drug", "first_approval", "marketed_now"), "drug", "left")
    year_ok = F.coalesce(F.abs(F.year("first_approval") - F.col("year")) <= tolerance, F.lit(False))
    market_ok = F.coalesce(F.col("marketed_now") == F.col("marketed"), F.lit(False))
    return got.select(
        "drug", "year", F.year("first_approval").alias("got_year"), "marketed", "marketed_now",
        ((F.col("year").isNull() | year_ok) & (F.col("marketed").isNull() | market_ok)).alias("passed"),
    )
