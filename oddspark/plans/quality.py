"""Control, invariant and census queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddspark.functions.stats import round_measures
from oddspark.operators import baskets as B
from oddspark.operators import counts as C
from oddspark.operators import outcomes, scoring
from oddspark.operators import quality as Q
from oddspark.plans import bias as PB
from oddspark.plans import sql as q
from oddspark.plans.registry import query
from oddspark.sources import given as G
from oddspark.sources.given import Given

# Bounds are about half of the measured ratios. The last two are meant to fail or be absent.
CONTROLS = [
    ("fr x LES", "positive", "fr", "LES", "ROR_above", 800.0, None),
    ("de x UND", "positive", "de", "UND", "ROR_above", 4000.0, None),
    ("es x EL", "positive", "es", "EL", "ROR_in_range", 2300.0, 9000.0),
    ("es x DEL", "positive", "es", "DEL", "ROR_above", 500.0, None),
    ("en x UND", "negative", "en", "UND", "no_signal", None, None),
    ("en x THE", "negative", "en", "THE", "no_signal", None, None),
    ("en x QQQQ", "negative", "en", "QQQQ", "absent", None, None),
]
_SCHEMA = "name string, kind string, drug string, reaction_pt string, check string, ror_min double, ror_max double"


def _literal(v) -> str:
    return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE")


_CONTROLS = "ctl AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, c)) + ")" for c in CONTROLS) + ") t(name, kind, drug, reaction_pt, chk, ror_min, ror_max))"
_GATE = "coalesce(a >= 3 AND ROR_lower > 1, false)"
_EVAL = f"""res AS (SELECT name, kind, ctl.drug, ctl.reaction_pt, chk, a, ROR, ROR_lower, ROR_upper, IC025,
  CASE chk WHEN 'ROR_in_range' THEN {_GATE} AND coalesce(ROR BETWEEN ror_min AND ror_max, false) WHEN 'ROR_above' THEN {_GATE} AND coalesce(ROR >= ror_min, false)
    WHEN 'no_signal' THEN NOT coalesce(IC025 > 1, false) ELSE a IS NULL END AS passed FROM ctl LEFT JOIN b_s USING (drug, reaction_pt))"""


def _results(g: Given):
    controls = g.spark.createDataFrame(CONTROLS, _SCHEMA)
    return Q.run_controls(scoring.score(g.documents(), ordered=False, rounded=False), controls)


@query(
    "controls",
    q.with_(q.B_SCORED, _CONTROLS, _EVAL)
    + f"SELECT name, kind, drug, reaction_pt, chk AS \"check\", a::DOUBLE AS a, {q.r4('ROR', 'ROR')}, {q.r4('ROR_lower', 'ROR_lower')}, {q.r4('ROR_upper', 'ROR_upper')}, {q.r4('IC025', 'IC025')}, passed FROM res",
)
def controls(g: Given):
    return round_measures(_results(g).withColumn("a", F.col("a").cast("double")))


@query(
    "control_summary",
    q.with_(q.B_SCORED, _CONTROLS, _EVAL) + "SELECT count(*) FILTER (passed) AS n_pass, count(*) AS n_total, bool_and(passed) AS passed FROM res",
)
def control_summary(g: Given):
    return Q.control_summary(_results(g))


_W = f"CAST('{G.RECENT[0]}' AS DATE) AND CAST('{G.RECENT[1]}' AS DATE)"


@query(
    "time_stability",
    q.with_(
        q.a_cells(), q.A_HEAD, f"w_rd AS (SELECT a_rd.* FROM a_rd JOIN a_head USING (report_id) WHERE receipt_date BETWEEN {_W})", q.cells("w", "w_rd", "a_rr"),
        "f AS (SELECT drug, reaction_pt, CASE WHEN b > 0 AND c > 0 THEN a::DOUBLE*d/(b::DOUBLE*c) END AS rf FROM a_t), r AS (SELECT drug, reaction_pt, a, CASE WHEN b > 0 AND c > 0 THEN a::DOUBLE*d/(b::DOUBLE*c) END AS rr FROM w_t)",
    )
    + f"SELECT drug, reaction_pt, coalesce(a, 0) AS a_recent, {q.r4('rr', 'ROR_recent')}, {q.r4('rf', 'ROR_full')}, coalesce((rr > 1) = (rf > 1), true) AS passed FROM f LEFT JOIN r USING (drug, reaction_pt)",
)
def time_stability(g: Given):
    return Q.time_stability(g.dated_orders(), *G.RECENT)


_PROFILE_CUT = PB.PROFILE_SQL


@query(
    "dq_scored",
    q.with_(_PROFILE_CUT, "k AS (SELECT count(*) AS n, count(*) FILTER (NOT diagnosed) AS u, max(ROR) FILTER (drug = 'NATION_0' AND reaction_pt = 'SMALL RING') AS r FROM prof)")
    + f"""SELECT 'rows' AS rule, n::DOUBLE AS value, n > 1000 AS ok FROM k UNION ALL SELECT 'diagnosed_share', {q.r4('(n - u)::DOUBLE / n')}, (n - u)::DOUBLE / n >= 0.99 FROM k
      UNION ALL SELECT 'undiagnosed_rows', u::DOUBLE, u = 0 FROM k UNION ALL SELECT 'anchor_ror', {q.r4('r')}, coalesce(r > 1.5 AND r < 1.6, false) FROM k""",
)
def dq_scored(g: Given):
    out = Q.expectations(PB.profiled(g), ("NATION_0", "SMALL RING"), 1.5, 1.6)
    return out.withColumn("value", F.rint(F.col("value") * 10000.0) / 10000.0)


_RULES = {
    "cells_sum_to_n": "a + b + c + d = N",
    "cells_not_negative": "least(a, b, c, d) >= 0",
    "ic_in_interval": "IC025 <= IC AND IC <= IC975",
    "ror_in_interval": "ROR_lower <= ROR AND ROR <= ROR_upper",
    "tier_matches_band": f"tier = {q.TIER}",
    "outcomes_within_a": "greatest(deaths, hospitalisations, life_threatening, disabling) <= a",
}


@query(
    "dq_invariants",
    q.with_(q.A_SCORED, q.A_HEAD, "sv AS (SELECT drug, reaction_pt, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("deaths", "hospitalisations", "life_threatening", "disabling")) + " FROM a_pairs JOIN a_head USING (report_id) GROUP BY ALL)",
            "z AS (SELECT * FROM a_s JOIN sv USING (drug, reaction_pt))")
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({c}, true)) AS violations FROM z" for n, c in _RULES.items())
    + " UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (drug, reaction_pt)) FROM z",
)
def dq_invariants(g: Given):
    base = g.dated_orders()
    scored = scoring.score(base, ordered=False, rounded=False)
    return Q.invariants(outcomes.attach_severity(scored, outcomes.pair_severity(base)))


_FIELDS = ["drug", "reaction_pt", "a", "b", "c", "d", "N", "ROR", "ROR_lower", "ROR_upper", "PRR", "chi2", "IC", "IC025", "IC975", "signal", "tier"]


@query(
    "field_census",
    q.with_(q.B_SCORED)
    + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count(*) - count({c}) AS nulls, {q.r4(f'(count(*) - count({c}))::DOUBLE / count(*)', 'null_rate')} FROM b_s" for c in _FIELDS),
)
def field_census(g: Given):
    return Q.field_census(scoring.score(g.documents(), ordered=False))


@query(
    "dead_classes",
    q.with_(q.A_LINES) + "SELECT n_name AS epc, r_name AS referenced_by FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT IN (SELECT drug FROM a_lines) UNION ALL SELECT n_name || ' [OLD]', r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 2",
)
def dead_classes(g: Given):
    nations = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    declared = nations.select(F.col("n_name").alias("epc"), F.col("r_name").alias("referenced_by"))
    misspelt = nations.where("n_nationkey < 2").select(F.concat("n_name", F.lit(" [OLD]")).alias("epc"), F.col("r_name").alias("referenced_by"))
    return Q.dead_classes(declared.unionByName(misspelt), C.drug_totals(B.eligible(g.orders())))
