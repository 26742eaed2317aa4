"""Steps that several queries share: what is costly is computed once."""

import re

import pytest
from pyspark.sql import functions as F

from oddspark.operators import baskets as B
from oddspark.operators import grams
from oddspark.plans import bias, load
from oddspark.sources.given import Given
from oddspark.sources.stored import StoredTable
from tests.conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_into_words_once(spark):
    plan = plan_of(B.eligible(Given(spark, str(DATA)).documents()))
    lines = [x for x in plan.splitlines() if "FileScan" not in x]
    assert sum(x.count("regexp_extract_all") for x in lines) == 1


def test_a_stored_table_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(500).select(F.col("id").cast("string").alias("drug"), F.col("id").alias("n")).mapInArrow(told, "drug string, n long")
    table = StoredTable(spark, str(tmp_path / "t"), {"by_drug": ["drug"], "by_n": ["n"]})
    version = table.publish(rows)
    assert seen.value == 500
    assert table.read("by_n").count() == table.read("by_drug").distinct().count() == 500
    assert table.folder.folders(version) == ["by_drug", "by_n"]


def test_only_runs_of_needles_are_filed(spark, monkeypatch):
    filed, inner = [], grams.publish
    monkeypatch.setattr(grams, "publish", lambda df, name: filed.append(inner(df, name)) or filed[-1])
    words = spark.createDataFrame([("unders",), ("rounded",), ("bb",), ("xyz",)], "word string")
    for needles, runs, expected in (
        (["und", "b", "zzz"], {"und", "b"}, {("und", "unders"), ("und", "rounded"), ("b", "bb")}),
        (["nded"], {"nde", "ded"}, {("nded", "rounded")}),
        ([], set(), set()),
    ):
        got = grams.substring_matches(spark.createDataFrame([(n,) for n in needles], "needle string"), words)
        assert {tuple(r) for r in got.collect()} == expected
        assert {r.gram for r in filed[-1].collect()} == runs


@pytest.mark.parametrize("name", ["indication_overlap", "format_profile", "bias_profile", "rescore"])
def test_line_items_are_gathered_before(spark, name):
    assert not re.search(r"l_orderkey", plan_of(load().QUERIES[name](spark, str(DATA))))


def test_nested_reports_are_written_before(spark):
    assert "l_orderkey" not in plan_of(load().QUERIES["score_suspects"](spark, str(DATA)))


@pytest.mark.parametrize("name", ["mgps_screening", "mgps_fit", "label_mentions"])
def test_words_of_documents_are_written_before(spark, name):
    assert "A-Za-z" not in plan_of(load().QUERIES[name](spark, str(DATA)))


def test_specificity_is_counted_without_measures(spark):
    g = Given(spark, str(DATA))
    load().QUERIES["term_specificity"](spark, str(DATA))
    assert g.stored("sources", lambda: None).columns == ["drug", "reaction_pt", "a"]


def test_written_orders_give_the_same_profile(spark):
    g = Given(spark, str(DATA))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(bias.profiled(g)) == key(bias.profiled(g, g.dated_orders()))


def test_tier_movement_counts_both_halves_in_one_pass(spark):
    """Documents of the first half are counted with the others; their texts are not read again."""
    found = load().QUERIES["tier_movement"](spark, str(DATA))
    assert "A-Za-z" not in plan_of(found) and "documents.parquet" not in plan_of(found)
