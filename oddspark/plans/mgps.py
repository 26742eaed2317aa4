"""Shrinkage and rescoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddspark.operators import baskets as B
from oddspark.operators import counts as C
from oddspark.operators import mgps as M
from oddspark.operators import rescore as R
from oddspark.operators import scoring
from oddspark.plans import sql as q
from oddspark.plans.registry import query
from oddspark.sources.given import Given
from oddspark.sources.sinks import publish

# Hyper-parameters for the queries checked against SQL; a fit is table-dependent.
FIXED = M.Params(0.502, 0.229, 323.7, 219.2, 0.664)


def _pairs(g: Given):
    return C.contingency(B.eligible(g.documents()))


def _written(g: Given):
    """The pairs, written once: a fit and what follows it read them again."""
    return publish(_pairs(g), "mgps_pairs")


def _lik(alpha: float, beta: float) -> str:
    return f"(lgamma({alpha} + a) - lgamma({alpha}) + {alpha}*ln({beta}/({beta}+e)) + a*ln(e/({beta}+e)))"


_EBGM = f"""e0 AS (SELECT drug, reaction_pt, a::DOUBLE AS a, (a+b)::DOUBLE * (a+c)::DOUBLE / N AS e FROM b_t),
e1 AS (SELECT *, 1/(1 + exp(ln(1-{FIXED.pi}) + {_lik(FIXED.alpha2, FIXED.beta2)} - ln({FIXED.pi}) - {_lik(FIXED.alpha1, FIXED.beta1)})) AS w FROM e0),
e2 AS (SELECT *, exp(w*({q.psi(f'(a+{FIXED.alpha1})')} - ln(e+{FIXED.beta1})) + (1-w)*({q.psi(f'(a+{FIXED.alpha2})')} - ln(e+{FIXED.beta2}))) AS g FROM e1)"""


@query("ebgm", q.with_(q.b_cells(), _EBGM) + f"SELECT drug, reaction_pt, {q.r4('e', 'expected')}, {q.r4('g', 'EBGM')} FROM e2")
def ebgm(g: Given):
    return M.round_mgps(M.with_ebgm(_pairs(g), FIXED).select("drug", "reaction_pt", "expected", "EBGM"))


@query("mgps_fit")
def mgps_fit(g: Given):
    pairs = _written(g)
    found = M.maximise(pairs)
    facts = found.params._asdict() | {"gain": found.likelihood - found.start_likelihood, "converged": found.converged}
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).select("pairs", *[F.lit(v).alias(n) for n, v in facts.items()])


@query("mgps")
def mgps(g: Given):
    pairs = _written(g)
    out = M.with_mgps(pairs, M.fit(pairs))
    return M.round_mgps(out.select("drug", "reaction_pt", "a", "expected", "EBGM", "EB05", "EB95"))


@query("mgps_screening")
def mgps_screening(g: Given):
    pairs = _written(g)
    return M.screening_share(M.with_mgps(pairs, M.fit(pairs)))


@query("rescore")
def rescore(g: Given):
    stored = publish(scoring.score(g.orders(), ordered=False), "rescored")
    return R.rescore(stored).select("drug", "reaction_pt", "a", "IC", "IC025", "IC975", "tier", "expected", "EBGM", "EB05", "EB95")


_BEFORE = ",\n".join([q.b_rd("lang", "p_rd"), q.b_rr(q.FIRST_HALF, "p_rr"), q.cells("p", "p_rd", "p_rr"), q.stats("p_t", "p_s")])


@query(
    "tier_movement",
    q.with_(_BEFORE, q.B_SCORED)
    + f"""SELECT p.tier AS old_tier, n.tier AS new_tier, count(*) AS pairs, {q.r4('avg(abs(n.IC025 - p.IC025))', 'mean_shift')},
      {q.r4('median(abs(n.IC025 - p.IC025))', 'median_shift')}, {q.r4('max(abs(n.IC025 - p.IC025))', 'max_shift')} FROM p_s p JOIN b_s n USING (drug, reaction_pt) GROUP BY ALL""",
)
def tier_movement(g: Given):
    halves = publish(C.pair_counts(B.eligible(g.documents(carry={"early": g.first_half()})), by=("early",)), "half_cells")
    return R.tier_movement(scoring.score_cells(halves.where("early")), scoring.score_cells(C.united(halves)))


@query(
    "interval_width",
    q.with_(q.B_SCORED)
    + f"""SELECT CASE WHEN a < 10 THEN 'a<10' WHEN a < 100 THEN 'a=10-99' WHEN a < 1000 THEN 'a=100-999' ELSE 'a>=1000' END AS band,
      count(*) AS pairs, {q.r4('median(IC975 - IC025)', 'median_width')} FROM b_s GROUP BY 1""",
)
def interval_width(g: Given):
    return R.interval_width(scoring.score(g.documents(), ordered=False, rounded=False))
