"""Nested spontaneous-report documents: schema, reading, normalising to long tables and baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark.operators.baskets import canonical_reaction

_STRINGS = T.ArrayType(T.StringType())

DRUG = T.StructType(
    [
        T.StructField("medicinalproduct", T.StringType()),
        T.StructField("drugindication", T.StringType()),
        T.StructField("drugcharacterization", T.StringType()),
        T.StructField("activesubstance", T.StructType([T.StructField("activesubstancename", T.StringType())])),
        T.StructField(
            "openfda",
            T.StructType(
                [T.StructField(n, _STRINGS) for n in ("generic_name", "brand_name", "substance_name", "pharm_class_epc")]
            ),
        ),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("safetyreportid", T.StringType()),
        T.StructField("receiptdate", T.StringType()),
        T.StructField("seriousnessdeath", T.StringType()),
        T.StructField("seriousnesshospitalization", T.StringType()),
        T.StructField("seriousnesslifethreatening", T.StringType()),
        T.StructField("seriousnessdisabling", T.StringType()),
        T.StructField("primarysource", T.StructType([T.StructField("qualification", T.StringType())])),
        T.StructField(
            "patient",
            T.StructType(
                [
                    T.StructField("patientsex", T.StringType()),
                    T.StructField("patientonsetage", T.StringType()),
                    T.StructField("drug", T.ArrayType(DRUG)),
                    T.StructField("reaction", T.ArrayType(T.StructType([T.StructField("reactionmeddrapt", T.StringType())]))),
                ]
            ),
        ),
    ]
)

SUSPECT, CONCOMITANT, INTERACTING = "1", "2", "3"


def read_reports(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """One row per report with the declared schema; nothing is inferred."""
    reader = spark.read.schema(REPORT)
    return reader.json(path) if fmt == "json" else reader.format(fmt).load(path)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name) == "1", F.lit(False))


def report_scan(reports: DataFrame) -> DataFrame:
    """Report header: date, outcome flags and the number of drug and reaction entries."""
    return reports.where(F.col("safetyreportid").isNotNull()).select(
        F.col("safetyreportid").alias("report_id"),
        F.to_date(F.try_to_timestamp("receiptdate", F.lit("yyyyMMdd"))).alias("receipt_date"),
        _flag("seriousnessdeath").alias("deaths"),
        _flag("seriousnesshospitalization").alias("hospitalisations"),
        _flag("seriousnesslifethreatening").alias("life_threatening"),
        _flag("seriousnessdisabling").alias("disabling"),
        F.col("primarysource.qualification").alias("qualification"),
        F.size(F.coalesce("patient.drug", F.array().cast(T.ArrayType(DRUG)))).alias("n_drugs"),
        F.size(F.coalesce("patient.reaction", F.array().cast(REPORT["patient"].dataType["reaction"].dataType))).alias("n_reactions"),
    )


def report_drug(reports: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """One row per drug entry with its names, classes, indication and role; optionally only some roles."""
    rows = reports.select(F.col("safetyreportid").alias("report_id"), F.explode("patient.drug").alias("d"))
    if roles is not None:
        rows = rows.where(F.col("d.drugcharacterization").isin(*roles))
    return rows.select(
        "report_id",
        F.col("d.drugcharacterization").alias("role"),
        F.col("d.drugindication").alias("indication"),
        F.col("d.openfda.pharm_class_epc").alias("epc"),
        F.lower(
            F.concat_ws(
                " | ", F.array_join("d.openfda.generic_name", " | "), F.col("d.activesubstance.activesubstancename"), F.col("d.medicinalproduct")
            )
        ).alias("haystack"),
    )


def class_baskets(reports: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Baskets at class level straight from the nested row: no explode, no shuffle."""
    entries = F.col("patient.drug")
    if roles is not None:
        entries = F.filter(entries, lambda d: d["drugcharacterization"].isin(*roles))
    classes = F.flatten(F.transform(entries, lambda d: F.coalesce(d["openfda"]["pharm_class_epc"], F.array().cast(_STRINGS))))
    reactions = F.transform("patient.reaction", lambda r: canonical_reaction(r["reactionmeddrapt"]))
    clean = lambda a: F.array_distinct(F.array_compact(F.coalesce(a, F.array().cast(_STRINGS))))
    head = report_scan(reports).drop("n_drugs", "n_reactions").columns[1:]
    flags = {c: report_scan_column(c) for c in head}
    return reports.where(F.col("safetyreportid").isNotNull()).select(
        F.col("safetyreportid").alias("report_id"), clean(classes).alias("drugs"), clean(reactions).alias("reactions"),
        *[expr.alias(name) for name, expr in flags.items()],
        clean(F.transform(entries, lambda d: d["drugindication"])).alias("indications"),
    )


def report_scan_column(name: str) -> Column:
    source = {
        "deaths": "seriousnessdeath", "hospitalisations": "seriousnesshospitalization",
        "life_threatening": "seriousnesslifethreatening", "disabling": "seriousnessdisabling",
    }
    if name in source:
        return _flag(source[name])
    if name == "receipt_date":
        return F.to_date(F.try_to_timestamp("receiptdate", F.lit("yyyyMMdd")))
    return F.col("primarysource.qualification")


def report_reaction(reports: DataFrame) -> DataFrame:
    return reports.select(
        F.col("safetyreportid").alias("report_id"), F.explode("patient.reaction.reactionmeddrapt").alias("reaction_pt")
    ).select("report_id", canonical_reaction(F.col("reaction_pt")).alias("reaction_pt"))
