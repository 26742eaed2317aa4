"""Queries on reporting over time, indications and comparator groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddspark.functions.special import round4
from oddspark.functions.stats import round_measures
from oddspark.operators import baskets as B
from oddspark.operators import bias as N
from oddspark.operators import counts as C
from oddspark.operators import scoring
from oddspark.plans import sql as q
from oddspark.plans.registry import query
from oddspark.sources.given import Given
from oddspark.sources.sinks import publish

_BASE = ",\n".join([q.a_cells(), q.A_HEAD, q.A_TREND])
_OK = "year(month) >= 1968"
_BURST = f"""a_burst AS (
  SELECT *, top::DOUBLE / reports AS raw_share FROM (
    SELECT drug, reaction_pt, CAST(coalesce(sum(n) FILTER ({_OK}), 0) AS BIGINT) AS reports,
           CAST(coalesce(sum(n) FILTER (NOT {_OK}), 0) AS BIGINT) AS dropped, max(n) FILTER ({_OK}) AS top FROM a_trend GROUP BY ALL))"""
_BURST_COLS = f"{q.r4('coalesce(raw_share, 0)', 'burstiness')}, coalesce(raw_share, 0) > {{t}} AS notoriety_spike"


@query("pair_trend", q.with_(_BASE) + "SELECT * FROM a_trend")
def pair_trend(g: Given):
    return N.pair_trend(g.dated_orders())


@query("trend_map", q.with_(_BASE) + "SELECT drug, reaction_pt, string_agg(strftime(month, '%Y-%m') || '=' || n, ',' ORDER BY month) AS trend FROM a_trend GROUP BY ALL")
def trend_map(g: Given):
    stored = N.trend_map(N.pair_trend(g.dated_orders()))
    entries = F.transform(F.map_entries("trend"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stored.select("drug", "reaction_pt", F.array_join(entries, ",").alias("trend"))


@query("burstiness", q.with_(_BASE, _BURST) + f"SELECT drug, reaction_pt, reports, dropped, {_BURST_COLS.format(t=0.25)} FROM a_burst")
def burstiness(g: Given):
    return N.burstiness(N.pair_trend(g.dated_orders()))


@query("burstiness_low_bar", q.with_(_BASE, _BURST) + f"SELECT drug, reaction_pt, reports, dropped, {_BURST_COLS.format(t=0.10)} FROM a_burst")
def burstiness_low_bar(g: Given):
    return N.burstiness(N.pair_trend(g.dated_orders()), threshold=0.10)


@query(
    "dense_trend",
    q.with_(_BASE, f"ok AS (SELECT * FROM a_trend WHERE {_OK})", "span AS (SELECT drug, reaction_pt, min(month) AS lo, max(month) AS hi FROM ok GROUP BY ALL)",
            "grid AS (SELECT drug, reaction_pt, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM span)")
    + "SELECT drug, reaction_pt, month, coalesce(n, 0) AS n FROM grid LEFT JOIN ok USING (drug, reaction_pt, month)",
)
def dense_trend(g: Given):
    return N.dense_trend(N.pair_trend(g.dated_orders()))


_ROLL = f"""ok AS (SELECT *, year(month)*12 + month(month) - 1 AS i FROM a_trend WHERE {_OK}),
span AS (SELECT drug, reaction_pt, min(i) AS lo, max(i) AS hi FROM ok GROUP BY ALL),
sized AS (SELECT *, CASE WHEN hi-lo+1 <= 40 THEN 1 WHEN hi//3 - lo//3 + 1 <= 116 THEN 3 ELSE 12 END AS width FROM span),
grid AS (SELECT drug, reaction_pt, width, unnest(range(lo//width, hi//width + 1)) AS slot FROM sized),
sums AS (SELECT drug, reaction_pt, i//width AS slot, sum(n) AS n FROM ok JOIN sized USING (drug, reaction_pt) GROUP BY ALL),
roll AS (SELECT drug, reaction_pt, CASE width WHEN 1 THEN 'monthly' WHEN 3 THEN 'quarterly' ELSE 'yearly' END AS unit,
  make_date((slot*width)//12, (slot*width)%12 + 1, 1) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN sums USING (drug, reaction_pt, slot))"""


@query("trend_rollup", q.with_(_BASE, _ROLL) + "SELECT * FROM roll")
def trend_rollup(g: Given):
    return N.rollup_trend(N.pair_trend(g.dated_orders()))


@query(
    "trend_summary",
    q.with_(_BASE, _ROLL, _BURST, f"bs AS (SELECT drug, reaction_pt, {_BURST_COLS.format(t=0.10)} FROM a_burst)",
            """z AS (SELECT drug, reaction_pt, unit, min(bucket) AS first, max(bucket) AS last, CAST(sum(n) AS BIGINT) AS total, count(*) AS points,
              arg_max(bucket, n * 100000 - (year(bucket)*12 + month(bucket))) AS peak, max(n) AS peak_n FROM roll GROUP BY ALL)""")
    + """SELECT z.*, burstiness, notoriety_spike, CASE WHEN unit = 'yearly' THEN strftime(first, '%Y') ELSE strftime(first, '%Y-%m') END || ' to ' ||
      CASE WHEN unit = 'yearly' THEN strftime(last, '%Y') ELSE strftime(last, '%Y-%m') END || ', ' || total || ' reports, ' || unit ||
      CASE WHEN notoriety_spike THEN '; ' || CAST(round_even(burstiness*100, 0) AS BIGINT) || '% in one month' ELSE '' END AS caption
      FROM z LEFT JOIN bs USING (drug, reaction_pt)""",
)
def trend_summary(g: Given):
    trend = N.pair_trend(g.dated_orders())
    return N.series_summary(N.rollup_trend(trend), N.burstiness(trend, threshold=0.10))


# --- indications ------------------------------------------------------------------

_IND = """ind AS (SELECT d.drug, upper(trim(l.indication)) AS indication, count(DISTINCT d.report_id) AS reports
  FROM a_rd d JOIN a_lines l USING (report_id) GROUP BY ALL)"""


@query("drug_indications", q.with_(q.A_LINES, q.A_RD, _IND) + "SELECT * FROM ind")
def drug_indications(g: Given):
    return N.drug_indications(g.dated_orders())


_OVERLAP = f"""words AS (SELECT drug, reaction_pt, {q.word_set('reaction_pt')} AS w FROM a_t),
iw AS (SELECT drug, {q.word_set('indication')} AS v FROM ind),
ov AS (SELECT w.drug, w.reaction_pt, coalesce(bool_or(len(list_intersect(w, v)) > 0 AND len(list_intersect(w, v)) >= 0.5 * len(w)), false) AS indication_overlap
  FROM words w LEFT JOIN iw ON iw.drug = w.drug GROUP BY ALL)"""


@query("indication_overlap", q.with_(q.a_cells(), _IND, _OVERLAP) + "SELECT drug, reaction_pt, indication_overlap FROM ov")
def indication_overlap(g: Given):
    base = publish(B.from_rows(g.order_lines(), carry={"indications": F.collect_set("indication")}), "indicated_orders")
    pairs = C.contingency(B.eligible(base)).select("drug", "reaction_pt")
    return N.indication_overlap(pairs, N.drug_indications(base))


# --- comparators ----------------------------------------------------------------------

_DIM = "cls AS (SELECT DISTINCT drug, area FROM a_lines), dim AS (SELECT x.drug, y.drug AS peer FROM cls x JOIN cls y ON x.area = y.area AND x.drug <> y.drug)"


def _dim(g: Given):
    classes = g.classes()
    return N.comparator_dim(classes, classes.select("area", "epc"))


@query(
    "comparator_dim",
    """WITH c AS (SELECT DISTINCT n_name AS class, r_name AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT x.class, y.class AS peer FROM c x JOIN c y ON x.area = y.area AND x.class <> y.class)
    SELECT class AS drug, peer FROM p UNION SELECT s_name, peer FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN p ON class = n_name""",
)
def comparator_dim(g: Given):
    classes = g.classes()
    members = g.suppliers().select(F.col("drug").alias("class"), "molecule")
    return N.comparator_dim(classes, classes.select("area", "epc"), members)


_AC = """grp AS (SELECT DISTINCT report_id, dim.drug FROM a_rd JOIN dim ON peer = a_rd.drug),
gt AS (SELECT drug, count(*) AS n FROM grp GROUP BY drug),
gc AS (SELECT drug, reaction_pt, count(*) AS a FROM grp JOIN a_rr USING (report_id) GROUP BY ALL),
rt AS (SELECT reaction_pt, count(*) AS ac FROM a_rr GROUP BY ALL),
ac0 AS (SELECT drug, reaction_pt, a, n - a AS b, ac - a AS c, (SELECT count(DISTINCT report_id) FROM a_lines) - n - ac + a AS d FROM gc JOIN gt USING (drug) JOIN rt USING (reaction_pt)),
ac AS (SELECT drug, reaction_pt, a AS comparator_a, b AS comparator_b, c AS comparator_c, d AS comparator_d, (a::DOUBLE * d) / (b::DOUBLE * c) AS ratio FROM ac0 WHERE b > 0 AND c > 0 AND d > 0)"""


@query(
    "active_comparator",
    q.with_(q.A_SCORED, _DIM, _AC)
    + f"""SELECT s.drug, s.reaction_pt, {q.r4('ROR', 'ROR')}, comparator_a, comparator_b, comparator_c, comparator_d, {q.r4('ratio', 'active_comparator_ror')},
      {q.r4('CASE WHEN ROR > 0 THEN (ROR - ratio) / ROR END', 'active_comparator_shrinkage')} FROM a_s s JOIN ac USING (drug, reaction_pt)""",
)
def active_comparator(g: Given):
    base = g.orders()
    ratios = N.active_comparator(base, _dim(g))
    scored = scoring.score(base, ordered=False, rounded=False).select("drug", "reaction_pt", "ROR")
    both = N.attach_active_comparator(scored, ratios).join(ratios.drop("active_comparator_ror"), ["drug", "reaction_pt"])
    return both.withColumns({c: round4(F.col(c)) for c in ("ROR", "active_comparator_ror", "active_comparator_shrinkage")})


@query(
    "direct_comparator",
    q.with_(
        q.a_cells(), _DIM,
        """oth AS (SELECT DISTINCT report_id, dim.drug FROM a_rd JOIN dim ON peer = a_rd.drug EXCEPT SELECT report_id, drug FROM a_rd),
ot AS (SELECT drug, count(*) AS n FROM oth GROUP BY drug), oc AS (SELECT drug, reaction_pt, count(*) AS c FROM oth JOIN a_rr USING (report_id) GROUP BY ALL),
dt AS (SELECT drug, reaction_pt, a, b, coalesce(oc.c, 0) AS c, n - coalesce(oc.c, 0) AS d, a + b + n AS N FROM (SELECT drug, reaction_pt, a, b FROM a_t) JOIN ot USING (drug) LEFT JOIN oc USING (drug, reaction_pt))""",
        q.stats("dt", "ds"),
    )
    + f"SELECT drug, reaction_pt, a, b, c, d, N, {q.r4('ROR', 'ROR')}, {q.r4('ROR_lower', 'ROR_lower')}, {q.r4('ROR_upper', 'ROR_upper')} FROM ds",
)
def direct_comparator(g: Given):
    return N.direct_comparator(g.orders(), _dim(g))


SPIKE = 0.05
_PROFILE = ",\n".join(
    [
        q.A_SCORED, q.A_HEAD, q.A_TREND, _BURST, _IND, _OVERLAP, _DIM, _AC,
        f"bb AS (SELECT drug, reaction_pt, {_BURST_COLS.format(t=SPIKE)} FROM a_burst)",
        """prof AS (SELECT s.*, true AS diagnosed, bb.burstiness, bb.notoriety_spike, ov.indication_overlap,
  ratio AS active_comparator_ror, CASE WHEN ROR > 0 THEN (ROR - ratio) / ROR END AS active_comparator_shrinkage FROM a_s s
  LEFT JOIN bb USING (drug, reaction_pt) LEFT JOIN ov USING (drug, reaction_pt) LEFT JOIN ac USING (drug, reaction_pt))""",
    ]
)
PROFILE_SQL = _PROFILE


def dated(g: Given):
    """Dated orders, written once: each diagnostic counts other columns of them, which would gather the line items anew."""
    return publish(g.dated_orders(), "dated_orders")


def profiled(g: Given, base=None):
    """Scored orders with every diagnostic, unrounded; ``base`` are dated orders that have been written."""
    base = dated(g) if base is None else base
    scored = scoring.score(base, ordered=False, rounded=False)
    return N.bias_profile(
        scored,
        N.burstiness(N.pair_trend(base), threshold=SPIKE),
        N.drug_indications(base),
        N.active_comparator(base, _dim(g)),
    )


@query(
    "bias_profile",
    q.with_(_PROFILE) + f"""SELECT {q.SCORED}, diagnosed, burstiness, notoriety_spike, indication_overlap, {q.r4('active_comparator_ror', 'active_comparator_ror')},
    {q.r4('active_comparator_shrinkage', 'active_comparator_shrinkage')} FROM prof""",
)
def bias_profile(g: Given):
    out = round_measures(profiled(g))
    return out.withColumns({c: round4(F.col(c)) for c in ("active_comparator_ror", "active_comparator_shrinkage")})
