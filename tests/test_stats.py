import math
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddspark.functions import gammadist as G
from oddspark.functions import special as P
from oddspark.functions import stats as S
from oddspark.operators import baskets as B
from oddspark.operators import counts as C
from oddspark.operators import mgps as M
from oddspark.operators import scoring
from oddspark.sources.given import Given

CELLS = "drug string, reaction_pt string, a long, b long, c long, d long, N long"


def table(spark, *cells):
    return spark.createDataFrame([(f"D{i}", "R", a, b, c, d, a + b + c + d) for i, (a, b, c, d) in enumerate(cells)], CELLS)


def test_special_functions(spark):
    xs = [0.05, 0.5, 1.0, 2.5, 10.0, 1234.5, 2e7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(
        "x", P.lgamma(F.col("x")).alias("lg"),
        P.over_all(P.DIGAMMA_BODY, "array(x)")[0].alias("psi"), P.over_all(P.TRIGAMMA_BODY, "array(x)")[0].alias("tri"),
    ).collect()
    for r in got:
        assert r["lg"] == pytest.approx(math.lgamma(r["x"]), rel=1e-11, abs=1e-11)
        step = max(1e-4, r["x"] * 1e-5)
        numeric = (math.lgamma(r["x"] + step) - math.lgamma(r["x"] - step)) / (2 * step)
        assert r["psi"] == pytest.approx(numeric, rel=1e-3)
    one = next(r for r in got if r["x"] == 1.0)
    assert one["psi"] == pytest.approx(-0.5772156649015329, abs=1e-11)
    assert one["tri"] == pytest.approx(math.pi**2 / 6, abs=1e-10)


def test_anchor(spark):
    r = scoring.measure(table(spark, (8820, 426752, 32257, 20224861))).first()
    assert r["ROR"] == pytest.approx(12.9585, abs=1e-4)
    assert (round(r["IC"], 5), round(r["IC025"], 5), round(r["IC975"], 5)) == (3.34898, 3.31554, 3.38242)
    assert r["signal"] and r["tier"] == "strong"


def test_undefined_cells(spark):
    rows = scoring.measure(table(spark, (5, 0, 3, 10), (5, 3, 0, 10), (5, 3, 2, 0), (2, 1, 1, 5000))).collect()
    for r in rows[:3]:
        assert r["ROR"] is None and r["PRR"] is None and r["chi2"] is None and not r["signal"] and r["IC"] is not None
    assert rows[3]["ROR"] is not None and rows[3]["tier"] == "none" and not rows[3]["signal"]


def test_single_pair_form(spark):
    rows = S.with_single_ror(table(spark, (5, 3, 2, 0), (5, 0, 2, 9), (0, 3, 2, 9))).collect()
    assert rows[0]["ROR"] == 0.0 and rows[0]["ROR_lower"] is None
    assert rows[1]["ROR"] is None
    assert rows[2]["ROR_lower"] is None


def brute(reports):
    """a, ab, ac, N from plain sets."""
    drug, reaction, cell, ids = defaultdict(set), defaultdict(set), defaultdict(set), set()
    for rid, drugs, reactions in reports:
        for d, r in product(drugs, reactions):
            drug[d].add(rid), reaction[r].add(rid), cell[d, r].add(rid), ids.add(rid)
    return {k: (len(v), len(drug[k[0]]), len(reaction[k[1]]), len(ids)) for k, v in cell.items()}


def test_counts_match_sets_with_one_hot_report(spark):
    rng = np.random.default_rng(1)
    reports = [(i, {f"D{k}" for k in rng.integers(0, 6, 3)}, {f"R{k}" for k in rng.integers(0, 9, 4)}) for i in range(60)]
    reports.append((99, {f"D{k}" for k in range(6)}, {f"R{k}" for k in range(9)}))
    rows = [(i, d, r.lower()) for i, ds, rs in reports for d in ds for r in rs]
    rows += [(99, "D1", "r1")] * (len(rows) // 2)  # a third of all rows belongs to one report
    rows += [(500, None, "r1"), (501, "D1", ""), (502, "D1", None), (None, "D1", "r1")]  # never eligible
    df = spark.createDataFrame(rows, "report_id long, drug string, reaction_pt string")
    got = {(r["drug"], r["reaction_pt"]): r for r in C.contingency(B.eligible(B.from_rows(df))).collect()}
    want = brute(reports)
    assert set(got) == set(want)
    for key, (a, ab, ac, n) in want.items():
        r = got[key]
        assert (r["a"], r["b"], r["c"], r["d"], r["N"]) == (a, ab - a, ac - a, n - ab - ac + a, n)
    long = B.from_long(df.select("report_id", "drug").distinct(), df.select("report_id", "reaction_pt").distinct())
    assert C.contingency(B.eligible(long)).count() == len(want)


def test_plan_reads_reports_once(spark):
    df = spark.range(1000).select(F.col("id").alias("report_id"), (F.col("id") % 7).cast("string").alias("drug"), (F.col("id") % 5).cast("string").alias("reaction_pt"))
    out = C.contingency(B.eligible(B.from_rows(df)))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_gamma_distribution():
    x = np.array([0.1, 0.7, 1.0, 3.0, 10.0])
    assert G.cdf(x, np.ones(5), np.ones(5)) == pytest.approx(1 - np.exp(-x), rel=1e-12)
    for shape in (3, 50, 500, 3000):
        for value in (0.9 * shape, shape, 1.1 * shape):
            k = np.arange(shape)
            tail = np.exp(-value + k * np.log(value) - np.array([math.lgamma(i + 1) for i in k])).sum()
            got = G.cdf(np.array([float(value)]), np.array([float(shape)]), np.ones(1))[0]
            assert got == pytest.approx(1 - tail, abs=1e-9)


def test_mixture_quantile_inverts_the_cdf():
    rng = np.random.default_rng(3)
    q, s1, r1, s2, r2 = rng.uniform(0, 1, 200), rng.uniform(0.2, 400, 200), rng.uniform(0.1, 90, 200), rng.uniform(0.2, 400, 200), rng.uniform(0.1, 90, 200)
    for p in (0.05, 0.95):
        x = G.mixture_quantile(p, q, s1, r1, s2, r2)
        assert q * G.cdf(x, s1, r1) + (1 - q) * G.cdf(x, s2, r2) == pytest.approx(np.full(200, p), abs=1e-8)


def test_mgps_scores_are_derivatives():
    n, e = np.array([0.0, 1, 5, 40, 900]), np.array([0.3, 1.2, 4.0, 55.0, 800.0])
    theta = M._to_free(M.K.MGPS_START)
    _, slope = M.scores(n, e, M._from_free(theta))
    for i in range(5):
        up, down = theta.copy(), theta.copy()
        up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
        change = (M.scores(n, e, M._from_free(up))[0] - M.scores(n, e, M._from_free(down))[0]) / 2e-5
        assert slope[:, i] == pytest.approx(change, rel=1e-5, abs=1e-7)


def test_mgps_second_derivatives():
    n, e, w = np.array([0.0, 1, 5, 40, 900]), np.array([0.3, 1.2, 4.0, 55.0, 800.0]), np.array([7.0, 1, 3, 2, 5])
    theta = M._to_free((0.7, 0.4, 3.0, 2.5, 0.4))
    curve = M._derivatives(n, e, w, M._from_free(theta))[2]
    assert curve == pytest.approx(curve.T, abs=1e-9)
    for i in range(5):
        up, down = theta.copy(), theta.copy()
        up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
        change = w @ (M.scores(n, e, M._from_free(up))[1] - M.scores(n, e, M._from_free(down))[1]) / 2e-5
        assert curve[i] == pytest.approx(change, rel=1e-5, abs=1e-6)


def test_mgps_step_promises_most_within_its_length():
    rng = np.random.default_rng(3)
    for case in range(40):
        curve = rng.normal(size=(5, 5))
        curve = curve + curve.T - (6 * np.eye(5) if case % 2 else 0)
        slope = rng.normal(size=5) * (0 if case == 2 else 1)
        move = M._newton(slope, curve, 0.7)
        assert np.linalg.norm(move) <= 0.7 * (1 + 1e-9)
        others = rng.normal(size=(400, 5))
        others *= 0.7 * rng.random((400, 1)) / np.linalg.norm(others, axis=1, keepdims=True)
        best = (others @ slope + np.einsum("ij,jk,ik->i", others, curve, others) / 2).max()
        assert slope @ move + move @ curve @ move / 2 >= best - 1e-9


def test_mgps_move_ends_at_the_first_limit():
    theta, move = np.array([11.0, -11.5, 0, 0, 0]), np.array([4.0, -1.0, 2.0, 0, 0])
    assert M._to_limit(theta, move) == pytest.approx([12.0, -11.75, 0.5, 0, 0])
    assert M._to_limit(theta, move / 8) == pytest.approx(theta + move / 8)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mgps_fit_of_the_given_tables(spark, sf):
    """No move of a tenth in one parameter, or in a shape and its rate, raises the likelihood by more than the tolerance."""
    pairs = C.contingency(B.eligible(Given(spark, f"/root/testdata/{sf}").documents()))
    found = M.maximise(pairs)
    assert found.converged and found.steps < 60
    n, e, w = (M.groups(pairs).toPandas()[c].to_numpy(float) for c in "new")
    theta = M._to_free(found.params)
    for i in (0, 1, 2, 3, 4, [0, 1], [2, 3]):
        for by in (-0.1, 0.1):
            other = theta.copy()
            other[i] = np.clip(other[i] + by, -M.FREE_LIMIT, M.FREE_LIMIT)
            assert w @ M.scores(n, e, M._from_free(other))[0] <= found.likelihood + 1e-6 * w.sum()


def test_mgps_fit_finds_planted_parameters(spark):
    rng = np.random.default_rng(8)
    size = 20000
    e = rng.uniform(0.5, 30, size).round(1)
    rate = np.where(rng.random(size) < 0.3, rng.gamma(0.8, 1 / 0.4, size), rng.gamma(6.0, 1 / 7.0, size))
    # margins of 1000 and 1000 * e among a million make an expected count of e
    cells = [(int(a), 1000 - int(a), int(round(1000 * x)) - int(a), 10**6) for a, x in zip(rng.poisson(rate * e), e)]
    found = M.maximise(spark.createDataFrame(cells, "a long, b long, c long, N long"))
    assert found.converged and found.likelihood > found.start_likelihood
    p = found.params if found.params.alpha1 < found.params.alpha2 else M.Params(*found.params[2:4], *found.params[:2], 1 - found.params.pi)
    assert p.alpha1 / p.beta1 == pytest.approx(2.0, rel=0.15) and p.alpha2 / p.beta2 == pytest.approx(6 / 7, rel=0.05) and p.pi == pytest.approx(0.3, abs=0.05)


def test_mgps_order(spark):
    rng = np.random.default_rng(5)
    cells = [tuple(int(v) for v in (rng.integers(1, 60), rng.integers(50, 900), rng.integers(50, 900), rng.integers(5000, 90000))) for _ in range(120)]
    pairs = table(spark, *cells)
    params = M.fit(pairs)
    assert all(v > 0 for v in params) and params.pi < 1
    for r in M.with_mgps(pairs, params).collect():
        assert r["EB05"] <= r["EBGM"] <= r["EB95"]
    empty = M.with_mgps(table(spark, (0, 5, 5, 90)), params).first()
    assert empty["EBGM"] is None and empty["EB05"] is None


@pytest.mark.parametrize("spread", ["equal", "poisson", "one gamma"])
def test_mgps_fit_of_a_table_without_two_components(spark, spread):
    """Where one component does, the weight or a shape runs to its limit; that is a fit too."""
    rng = np.random.default_rng(4)
    e = rng.uniform(1, 20, 3000).round(1)
    n = {"equal": np.round(e), "poisson": rng.poisson(e), "one gamma": rng.poisson(e * rng.gamma(3.0, 1 / 3.0, len(e)))}[spread]
    cells = [(int(a), 1000 - int(a), int(round(1000 * x)) - int(a), 10**6) for a, x in zip(n, e)]
    pairs = spark.createDataFrame(cells, "a long, b long, c long, N long")
    found = M.maximise(pairs)
    assert found.converged and found.likelihood >= found.start_likelihood and all(np.isfinite(found.params))
    for r in M.with_mgps(pairs.limit(200), found.params).where("a > 0").collect():
        assert r["EB05"] <= r["EBGM"] * (1 + 1e-9) and r["EBGM"] <= r["EB95"] * (1 + 1e-9)
    assert M.scores(np.array([3.0]), np.array([2.0]), M.Params(1.0, 1.0, 2.0, 2.0, 1.0))[0] == pytest.approx(M.scores(np.array([3.0]), np.array([2.0]), M.Params(1.0, 1.0, 5.0, 9.0, 1.0))[0], rel=1e-4)
