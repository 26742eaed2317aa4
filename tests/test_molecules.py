"""Molecules beside classes from nested reports, with hot names and awkward entries."""

from pyspark.sql import functions as F

from oddspark.operators import facts as X
from oddspark.operators import scoring
from oddspark.sources import reports as R

FORMS = [("warfarin", "warfarin"), ("warfarin", "coumadin"), ("beta_x", "beta x"), ("ace", "ace")]


def _entry(product, classes=None, role=R.SUSPECT, generic=None):
    return (product, None, role, (None,), (generic, None, None, classes))


def _report(number, entries, terms):
    return (number, "20240101", *[None] * 4, None, (None, None, entries, [(t,) for t in terms]))


def _baskets(spark, rows, roles=None):
    nested = spark.createDataFrame(rows, R.REPORT)
    forms = spark.createDataFrame(FORMS, "molecule string, term string")
    baskets = R.class_baskets(nested, roles).select("report_id", "drugs", "reactions")
    return X.molecule_baskets(baskets, R.report_drug(nested, roles), forms)


def test_molecules_stand_beside_classes(spark):
    rows = [
        _report("1", [_entry("COUMADIN 5MG", ["Anticoagulant"]), _entry("Warfarin sodium"), _entry("Ace inhibitor", role=R.CONCOMITANT)], ["Rash"]),
        _report("2", [_entry("Placebo", ["Other"]), _entry("aces")], ["Rash"]),
        _report("3", [_entry("", None, generic=["Beta X", "none"])], ["Nausea", None]),
        _report("4", None, ["Rash"]),
        _report("5", [], []),
        _report(None, [_entry("warfarin")], ["Rash"]),
    ]
    got = {r["report_id"]: r["drugs"] for r in _baskets(spark, rows).collect()}
    assert got == {"1": ["Anticoagulant", "ace", "warfarin"], "2": ["Other"], "3": ["beta_x"], "4": [], "5": []}
    suspects = {r["report_id"]: r["drugs"] for r in _baskets(spark, rows, [R.SUSPECT]).collect()}
    assert suspects["1"] == ["Anticoagulant", "warfarin"]
    assert _baskets(spark, []).count() == 0


def test_one_name_in_most_reports_is_dealt_over_tasks(spark):
    records = spark.range(20_000).select(F.col("id").alias("report_id"), F.when(F.col("id") % 10 < 9, "warfarin 5 mg").otherwise(F.concat(F.lit("ace "), "id")).alias("haystack"))
    forms = spark.createDataFrame(FORMS, "molecule string, term string")
    hits = X.facts_match(records, forms)
    counts = {r["molecule"]: r["count"] for r in hits.groupBy("molecule").count().collect()}
    assert counts == {"warfarin": 18_000, "ace": 2_000}
    salts = records.where("report_id % 10 < 9").groupBy(F.pmod(F.xxhash64("report_id"), F.lit(X.SALTS))).count().agg(F.max("count")).first()[0]
    assert salts < 2 * 18_000 / X.SALTS


def test_scores_of_both_levels_use_one_total(spark):
    rows = [_report(str(i), [_entry("warfarin" if i % 2 else "other", ["C" if i % 3 else "D"])], ["Rash" if i % 5 else "Nausea"]) for i in range(40)]
    scored = scoring.score(_baskets(spark, rows)).collect()
    assert {r["drug"] for r in scored} == {"C", "D", "warfarin"} and {r["N"] for r in scored} == {40}
    cell = next(r for r in scored if (r["drug"], r["reaction_pt"]) == ("warfarin", "RASH"))
    assert cell["a"] == sum(1 for i in range(40) if i % 2 and i % 5)
