"""Every scored pair gets its label columns, with and without a tier; a sample of them against brute force."""

from collections import defaultdict

from oddspark.functions import text as X
from oddspark.operators import labels as L
from oddspark.operators import scoring
from oddspark.plans import load
from oddspark.sources.given import Given
from pyspark.sql import functions as F
from tests.conftest import DATA


def test_every_pair_is_looked_up(spark):
    g = Given(spark, str(DATA))
    pairs = {(r.drug, r.reaction_pt) for r in scoring.score(g.documents(), ordered=False, rounded=False).select("drug", "reaction_pt").collect()}
    rows = load().QUERIES["expectedness"](spark, str(DATA)).collect()
    got = {(r.drug, r.reaction_pt): r for r in rows}
    assert set(got) == pairs and len(rows) == len(pairs) and any(r.tier == "none" for r in rows)
    texts = defaultdict(list)
    for r in L.harm_text(g.label_documents()).collect():
        texts[r.drug].append(r)
    sample = sorted(pairs)[:: max(1, len(pairs) // 40)]
    trial = [(d, p, t.text, t.boxed, bool(t.found)) for d, p in sample for t in texts[d]]
    hit, boxed = X.label_hits(F.col("p"), F.col("t"), F.col("b"))
    shape = "d string, p string, t string, b string, f boolean"
    tested = spark.createDataFrame(trial, shape).where("f").select("d", "p", hit.alias("hit"), boxed.alias("boxed")).collect()
    for d, p in sample:
        mine, r = [x for x in tested if (x.d, x.p) == (d, p)], got[d, p]
        assert r.label_found == any(t.found for t in texts[d])
        if mine:
            assert r.labelled == any(x.hit for x in mine) and r.boxed_warning == any(x.boxed for x in mine)
