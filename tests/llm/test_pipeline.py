"""The pipeline's stages on the awkward table and on the smallest given tables; check SQL of the queries that have it."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from oddspark.llm.common import publish
from oddspark.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.llm.data import awkward_rows, docs_of
from tests.llm.test_operators import WORD, groups_of, removed, simhash_of


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = awkward_rows()
    got = tuples(corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, extra=True), str(DATA)))
    group = groups_of([r[0] for r in rows], [simhash_of(r[1]) for r in rows])
    expected = {r for r, g in zip(rows, group) if r[0] is None or r[0] == g}
    assert Counter(got) == Counter(expected)


def test_passage_stage(spark):
    rows = awkward_rows()
    got = corpus_pipeline.remove_repeated_passages(spark, docs_of(spark), str(DATA)).collect()
    expected = {d for d, n, gone, _, _ in removed(rows) if gone < n or n == 0}
    assert {r.doc_id for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got)


def test_mixing_stage_repeats_whole_texts(spark):
    rows = awkward_rows()
    got = corpus_pipeline.mix_sources(spark, docs_of(spark), str(DATA)).collect()
    texts = {r[0]: r[1] or "" for r in rows if r[0]}
    times = Counter()
    for r in got:
        assert r.doc_id is None or texts[r.doc_id].startswith(r.text)
        assert WORD.search(r.text)
        times[r.doc_id] += 1
    assert max(times[d] for d in times if d not in (None, 18)) <= 2


def test_pipeline_runs_and_matches_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = publish(stage(spark, docs, str(DATA)), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    last = tuples(corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).select("doc_id", "start", "length", "ids_crc32"))
    assert Counter(last) == Counter(tuples(corpus_pipeline.run(spark, str(DATA)).select("doc_id", "start", "length", "ids_crc32")))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("benchmark", "conversations", "documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(str, tuples(df.select(*columns)))) == Counter(map(str, found.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
