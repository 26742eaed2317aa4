"""Counting and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddspark.functions import stats as S
from oddspark.operators import baskets as B
from oddspark.operators import counts as C
from oddspark.operators import facts as X
from oddspark.operators import lookup, outcomes, scoring, strata
from oddspark.plans import sql as q
from oddspark.plans.registry import query
from oddspark.sources import given as G
from oddspark.sources import sinks
from oddspark.sources.given import Given

_FLAGS = "deaths, hospitalisations, life_threatening, disabling"


@query(
    "report_scan",
    q.with_(q.A_LINES, q.A_HEAD)
    + f"""SELECT h.report_id, receipt_date, {_FLAGS}, n_drugs, n_reactions, n_indications FROM a_head h JOIN (
      SELECT report_id, count(DISTINCT drug) AS n_drugs, count(DISTINCT reaction_pt) AS n_reactions,
             count(DISTINCT indication) AS n_indications FROM a_lines GROUP BY report_id) USING (report_id)""",
)
def report_scan(g: Given):
    size = lambda c: F.size(c).cast("long")
    return g.dated_orders().select(
        "report_id", "receipt_date", "deaths", "hospitalisations", "life_threatening", "disabling",
        size("drugs").alias("n_drugs"), size("reactions").alias("n_reactions"), size("indications").alias("n_indications"),
    )


@query(
    "report_pairs",
    q.with_(q.A_LINES, q.A_RD, q.A_RR) + "SELECT report_id, drug, reaction_pt FROM a_rd JOIN a_rr USING (report_id)",
)
def report_pairs(g: Given):
    return B.report_pairs(B.eligible(g.orders()))


@query(
    "count_reports",
    q.with_(q.A_LINES)
    + """, f AS (SELECT report_id, bool_or(drug = 'NATION_0') AS x, bool_or(reaction_pt = 'SMALL RING') AS y FROM a_lines GROUP BY report_id)
    SELECT predicate, CAST(reports AS BIGINT) AS reports FROM (
      SELECT 'all' AS predicate, count(*) AS reports FROM f UNION ALL SELECT 'class', count(*) FILTER (x) FROM f
      UNION ALL SELECT 'reaction', count(*) FILTER (y) FROM f UNION ALL SELECT 'class and reaction', count(*) FILTER (x AND y) FROM f
      UNION ALL SELECT 'class or reaction', count(*) FILTER (x OR y) FROM f)""".replace(", f AS", ",\nf AS", 1),
)
def count_reports(g: Given):
    x, y = F.array_contains("drugs", "NATION_0"), F.array_contains("reactions", "SMALL RING")
    return C.count_reports(
        g.orders(), {"all": F.lit(True), "class": x, "reaction": y, "class and reaction": x & y, "class or reaction": x | y}
    )


@query(
    "value_counts",
    q.with_(q.A_LINES)
    + "SELECT reaction_pt AS value, count(DISTINCT report_id) AS reports FROM a_lines WHERE report_id IN (SELECT report_id FROM a_lines WHERE drug = 'NATION_0') GROUP BY 1",
)
def value_counts(g: Given):
    return C.value_counts(g.orders(), "reactions", F.array_contains("drugs", "NATION_0"))


@query("drug_totals", q.with_(q.A_LINES) + "SELECT molecule AS drug, count(DISTINCT report_id) AS reports FROM a_lines GROUP BY 1")
def drug_totals(g: Given):
    return C.drug_totals(B.eligible(g.orders("molecule")))


@query(
    "reaction_totals",
    q.with_(q.b_rr()) + "SELECT reaction_pt, count(DISTINCT report_id) AS reports FROM b_rr GROUP BY 1",
)
def reaction_totals(g: Given):
    return C.reaction_totals(B.eligible(g.documents()))


@query("contingency", q.with_(q.a_cells()) + "SELECT * FROM a_t")
def contingency(g: Given):
    return C.contingency(B.eligible(g.orders()))


_ONE = q.with_(q.A_LINES) + """, f AS (SELECT report_id, bool_or(drug = 'NATION_0') AS x, bool_or(reaction_pt = 'SMALL RING') AS y FROM a_lines GROUP BY report_id),
k AS (SELECT count(*) FILTER (x AND y) AS a, count(*) FILTER (x) AS ab, count(*) FILTER (y) AS ac, count(*) AS N FROM f),
one AS (SELECT 'NATION_0' AS drug, 'SMALL RING' AS reaction_pt, a, greatest(ab - a, 0) AS b, greatest(ac - a, 0) AS c, greatest(N - ab - ac + a, 0) AS d, N FROM k)"""


@query("contingency_one", _ONE + "SELECT * FROM one")
def contingency_one(g: Given):
    return C.contingency_one(g.orders(), "NATION_0", "Small Ring")


@query(
    "score_one",
    _ONE + ",\n" + q.stats("one", "s", single=True)
    + f"SELECT drug, reaction_pt, a, b, c, d, N, {q.r4('ROR', 'ROR')}, {q.r4('ROR_lower', 'ROR_lower')}, {q.r4('ROR_upper', 'ROR_upper')}, {q.r4('IC', 'IC')}, {q.r4('IC025', 'IC025')}, {q.r4('IC975', 'IC975')} FROM s",
)
def score_one(g: Given):
    return scoring.score_one(g.orders(), "NATION_0", "Small Ring")


@query("score_pairs", q.with_(q.A_SCORED) + f"SELECT {q.SCORED} FROM a_s")
def score_pairs(g: Given):
    return scoring.score(g.orders())


@query("score_pairs_molecule", q.with_(q.a_cells("molecule"), q.stats("a_t", "a_s")) + f"SELECT {q.SCORED} FROM a_s")
def score_pairs_molecule(g: Given):
    return scoring.score(g.orders("molecule"))


@query("score_documents", q.with_(q.B_SCORED) + f"SELECT {q.SCORED} FROM b_s")
def score_documents(g: Given):
    return scoring.score(g.documents())


@query("score_sources", q.with_(q.b_cells("source"), q.stats("b_t", "b_s")) + f"SELECT {q.SCORED} FROM b_s")
def score_sources(g: Given):
    return scoring.score(g.documents("source"))


@query("score_pairs_filtered", q.with_(q.A_SCORED) + f"SELECT {q.SCORED} FROM a_s WHERE drug = 'NATION_0' AND reaction_pt IN ('SMALL RING', 'RED BOLT')")
def score_pairs_filtered(g: Given):
    return scoring.score(g.orders(), drug_filter="NATION_0", reaction_filter=["SMALL RING", "RED BOLT"])


_WINDOW = f"CAST('{G.RECENT[0]}' AS DATE) AND CAST('{G.RECENT[1]}' AS DATE)"
_RECENT = ",\n".join(
    [
        q.A_LINES, q.A_HEAD,
        f"w_rd AS (SELECT DISTINCT report_id, drug FROM a_lines JOIN a_head USING (report_id) WHERE receipt_date BETWEEN {_WINDOW})",
        q.A_RR, q.cells("w", "w_rd", "a_rr"), q.stats("w_t", "w_s"),
    ]
)


def _recent(g: Given):
    first, last = (F.lit(d).cast("date") for d in G.RECENT)
    return g.dated_orders().where(F.col("receipt_date").between(first, last))


@query("score_window", q.with_(_RECENT) + f"SELECT {q.SCORED} FROM w_s")
def score_window(g: Given):
    return scoring.score(_recent(g))


@query("ror_api", q.with_(q.b_cells(), q.stats("b_t", "s", single=True)) + f"SELECT drug, reaction_pt, a, b, c, d, {q.r4('ROR', 'ROR')}, {q.r4('ROR_lower', 'ROR_lower')}, {q.r4('ROR_upper', 'ROR_upper')} FROM s")
def ror_api(g: Given):
    one = S.with_single_ror(C.contingency(B.eligible(g.documents())))
    return S.round_measures(one.select("drug", "reaction_pt", "a", "b", "c", "d", "ROR", "ROR_lower", "ROR_upper"))


@query("bcpnn", q.with_(q.B_SCORED) + f"SELECT drug, reaction_pt, a, {q.r4('IC', 'IC')}, {q.r4('IC025', 'IC025')}, {q.r4('IC975', 'IC975')}, tier FROM b_s")
def bcpnn(g: Given):
    ic = S.with_bcpnn(C.contingency(B.eligible(g.documents()))).withColumn("tier", S.tier(F.col("IC025"), F.col("a")))
    return S.round_measures(ic.select("drug", "reaction_pt", "a", "IC", "IC025", "IC975", "tier"))


_DME = q.quoted(G.DESIGNATED)


@query("dme_counts", q.with_(q.A_LINES) + f"SELECT drug, reaction_pt, count(DISTINCT report_id) AS a FROM (SELECT DISTINCT l.drug, r.reaction_pt, l.report_id FROM a_lines l JOIN a_lines r USING (report_id)) WHERE reaction_pt IN ({_DME}) GROUP BY ALL")
def dme_counts(g: Given):
    return C.designated_counts(B.eligible(g.orders()), g.designated())


_TOP = 20
_CANDIDATES = f"""cand AS (SELECT *, CASE WHEN rn <= {_TOP} THEN CAST(rn AS INTEGER) ELSE 0 END AS freq_rank, reaction_pt IN ({_DME}) AS dme FROM (
  SELECT *, row_number() OVER (PARTITION BY drug ORDER BY a DESC, reaction_pt) AS rn FROM a_t) WHERE rn <= {_TOP} OR reaction_pt IN ({_DME}))"""


@query("candidates", q.with_(q.a_cells(), _CANDIDATES) + "SELECT drug, reaction_pt, a, freq_rank, dme FROM cand")
def candidates(g: Given):
    picked = C.candidates(C.contingency(B.eligible(g.orders())), g.designated(), _TOP)
    return picked.select("drug", "reaction_pt", "a", F.coalesce("freq_rank", F.lit(0)).alias("freq_rank"), "dme")


_COUNTED = ",\n".join(
    [
        q.a_cells(),
        f"kept AS (SELECT drug, reaction_pt, a, b, c, d, N, reaction_pt IN ({_DME}) AS dme FROM a_t WHERE reaction_pt NOT LIKE '%{G.STOPLIST_SUFFIX}' AND b > 0 AND c > 0 AND d > 0)",
        q.stats("kept", "k_s", single=True),
    ]
)


def counted(g: Given, **kw):
    return scoring.score_counts(g.orders(), g.stoplist(), g.designated(), **kw)


@query("score_counts", q.with_(_COUNTED) + f"SELECT {q.SCORED}, dme FROM k_s")
def score_counts(g: Given):
    return counted(g)


@query("run_summary", q.with_(_COUNTED) + "SELECT drug, count(*) AS pairs, count(*) FILTER (tier = 'strong') AS strong, count(*) FILTER (tier <> 'none') AS tiered, count(*) FILTER (signal) AS signals, count(*) FILTER (dme) AS designated FROM k_s GROUP BY drug")
def run_summary(g: Given):
    return scoring.run_summary(counted(g, ordered=False, rounded=False))


def _finished(g: Given):
    return g.suppliers().where(F.col("area") == "ASIA").select("drug")


@query("incremental_score", q.with_(q.A_SCORED) + f"SELECT {q.SCORED} FROM a_s WHERE drug NOT IN (SELECT drug FROM a_lines WHERE area = 'ASIA')")
def incremental_score(g: Given):
    return scoring.incremental(g.orders(), _finished(g))


@query(
    "merge_scored",
    q.with_(_RECENT, q.A_RD, q.cells("a", "a_rd", "a_rr"), q.stats("a_t", "a_s"))
    + f""", z AS (SELECT 0 AS o, * FROM w_s UNION ALL SELECT 1 AS o, * FROM a_s WHERE drug IN (SELECT drug FROM a_lines WHERE area = 'ASIA'))
    SELECT {q.SCORED} FROM (SELECT *, row_number() OVER (PARTITION BY drug, reaction_pt ORDER BY o DESC) AS rn FROM z) WHERE rn = 1""",
)
def merge_scored(g: Given):
    fresh = scoring.score(g.orders(), ordered=False).join(_finished(g).distinct(), "drug", "left_semi")
    return scoring.merge([scoring.score(_recent(g), ordered=False), fresh])


@query("publish_scored", q.with_(q.A_SCORED) + f"SELECT {q.SCORED} FROM a_s")
def publish_scored(g: Given):
    return sinks.publish_scored(scoring.score(g.orders(), ordered=False))


@query(
    "molecule_reports",
    q.with_(
        "v AS (SELECT unnest([" + q.quoted(G.NOUNS) + "]) AS molecule)",
        "h AS (SELECT DISTINCT l_orderkey AS report_id, lower(p_name || ' | ' || p_type || ' | ' || p_brand) AS hay FROM lineitem JOIN part ON l_partkey = p_partkey)",
    )
    + r"SELECT molecule, count(DISTINCT report_id) AS reports FROM h JOIN v ON regexp_matches(hay, '\b' || molecule || 's?\b') GROUP BY molecule",
)
def molecule_reports(g: Given):
    hay = F.lower(F.concat_ws(" | ", "p_name", "p_type", "p_brand"))
    products = g.table("lineitem").join(g.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("report_id"), hay.alias("haystack"))
    nouns = g.spark.createDataFrame([(n, t) for n in G.NOUNS for t in (n, n + "s")], "molecule string, term string")
    return X.molecule_reports(products, nouns)


@query(
    "dim_alias",
    """SELECT DISTINCT alias, drug FROM (
      SELECT lower(n_name) AS alias, n_name AS drug FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT lower(s_name), s_name FROM supplier UNION ALL SELECT lower(replace(s_name, '#', ' ')), s_name FROM supplier)""",
)
def dim_alias(g: Given):
    return lookup.alias_dim(g.catalogue())


_SHARES = ", ".join(f"CASE WHEN {c} <= a THEN {q.r4(f'{c}::DOUBLE / a')} END AS {c}_share" for c in ("deaths", "hospitalisations", "life_threatening", "disabling"))


@query(
    "pair_severity",
    q.with_(
        q.A_LINES, q.A_RD, q.A_RR, q.A_HEAD,
        "k AS (SELECT drug, reaction_pt, count(*) AS a, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("deaths", "hospitalisations", "life_threatening", "disabling"))
        + " FROM a_rd JOIN a_rr USING (report_id) JOIN a_head USING (report_id) GROUP BY ALL)",
    )
    + f"SELECT *, greatest(deaths, hospitalisations, life_threatening, disabling) <= a AS severity_base_ok, {_SHARES} FROM k",
)
def pair_severity(g: Given):
    return outcomes.pair_severity(g.dated_orders())


_STRATA = f"""s_t AS (
  SELECT stratum, drug, reaction_pt, a, ab - a AS b, ac - a AS c, N - ab - ac + a AS d, N
  FROM (SELECT stratum, drug, reaction_pt, count(*) AS a FROM sp GROUP BY ALL)
  JOIN (SELECT stratum, drug, count(DISTINCT report_id) AS ab FROM sp GROUP BY ALL) USING (stratum, drug)
  JOIN (SELECT stratum, reaction_pt, count(DISTINCT report_id) AS ac FROM sp GROUP BY ALL) USING (stratum, reaction_pt)
  JOIN (SELECT stratum, count(DISTINCT report_id) AS N FROM sp GROUP BY ALL) USING (stratum))"""
_STRATIFIED = ",\n".join(
    [
        q.a_cells(), "sp AS (SELECT p.*, o_orderstatus AS stratum FROM a_pairs p JOIN orders ON o_orderkey = report_id)", _STRATA,
        q.stats("s_t", "s_s"), q.stats("a_t", "a_s"),
    ]
)


def _stratified(g: Given):
    status = g.table("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("status"))
    return g.orders().join(status, "report_id")


@query("score_strata", q.with_(_STRATIFIED) + f"SELECT stratum, drug, reaction_pt, a, b, c, d, N, {q.r4('ROR', 'ROR')}, {q.r4('ROR_lower', 'ROR_lower')}, {q.r4('ROR_upper', 'ROR_upper')} FROM s_s")
def score_strata(g: Given):
    return S.round_measures(strata.score_by_stratum(_stratified(g), "status"))


@query(
    "simpson_check",
    q.with_(_STRATIFIED)
    + f""", k AS (SELECT drug, reaction_pt, count(*) AS strata, count(*) FILTER (ROR > 1) AS above FROM s_s WHERE ROR IS NOT NULL GROUP BY ALL)
    SELECT drug, reaction_pt, strata, above, {q.r4('ROR', 'ror_overall')}, (ROR > 1 AND above = 0) OR (ROR <= 1 AND above = strata) AS reversed
    FROM k JOIN a_s USING (drug, reaction_pt) WHERE ROR IS NOT NULL""",
)
def simpson_check(g: Given):
    base = _stratified(g)
    return strata.simpson_check(strata.score_by_stratum(base, "status"), scoring.score(g.orders(), ordered=False, rounded=False))


@query(
    "reporter_mix",
    q.with_(q.a_cells(), "m AS (SELECT drug, reaction_pt, c_mktsegment AS qualification, count(*) AS reports FROM a_pairs JOIN orders ON o_orderkey = report_id JOIN customer ON o_custkey = c_custkey GROUP BY ALL)")
    + f"SELECT *, {q.r4('reports::DOUBLE / sum(reports) OVER (PARTITION BY drug, reaction_pt)', 'share')} FROM m",
)
def reporter_mix(g: Given):
    who = (
        g.table("orders").join(g.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("report_id"), F.col("c_mktsegment").alias("qualification"))
    )
    return strata.reporter_mix(g.orders().join(who, "report_id"), "qualification")


@query(
    "interaction_statistic",
    q.with_(q.a_cells(), "gold AS (SELECT x.drug AS a, y.drug AS b, 'RED BOLT' AS expect FROM (SELECT DISTINCT drug, area FROM a_lines) x JOIN (SELECT DISTINCT drug, area FROM a_lines) y ON x.area = y.area AND x.drug < y.drug)",
            """nab AS (SELECT gold.a, gold.b, expect, count(*) AS n_ab, count(*) FILTER (report_id IN (SELECT report_id FROM a_rr WHERE reaction_pt = 'RED BOLT')) AS observed
      FROM gold JOIN a_rd x ON x.drug = gold.a JOIN a_rd y USING (report_id) WHERE y.drug = gold.b GROUP BY ALL)""",
            "e AS (SELECT nab.*, n_ab * (ta.a/(ta.a+ta.b)) * (tb.a/(tb.a+tb.b)) / ((ta.a+ta.c)/ta.N) AS ex FROM nab LEFT JOIN a_t ta ON ta.drug = nab.a AND ta.reaction_pt = expect LEFT JOIN a_t tb ON tb.drug = nab.b AND tb.reaction_pt = expect)")
    + f"SELECT a, b, expect, n_ab, observed, {q.r4('ex', 'expected_joint')}, {q.r4('log2((observed + 0.5) / (ex + 0.5))', 'omega')} FROM e",
)
def interaction_statistic(g: Given):
    one = g.suppliers().select("area", "drug").distinct()
    pairs = one.withColumnRenamed("drug", "a").join(one.withColumnRenamed("drug", "b"), "area").where("a < b")
    return strata.interaction_statistic(g.orders(), pairs.select("a", "b", F.lit("RED BOLT").alias("expect")))
