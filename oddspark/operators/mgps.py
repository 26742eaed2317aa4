"""Gamma-Poisson shrinkage: table-level fit, EBGM and its credible bounds.

The prior is fitted to every pair with a positive expected count. Spark groups the
pairs by their exact (observed, expected) values and evaluates, in one aggregation a
step, the likelihood, its gradient and its second derivatives over all groups, for each
of three searches; only these 93 sums reach the driver, which takes Newton steps inside
trusted radii.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark import constants as K
from oddspark.functions import gammadist as G
from oddspark.functions.special import DIGAMMA_BODY, lgamma, over_all, round4
from oddspark.functions.stats import with_expected

MAX_STEPS = 300
#: Largest absolute logarithm of a shape or rate and logit of the weight.
FREE_LIMIT = 12.0
#: The fit has converged when a step promises less than this much likelihood per pair.
TOLERANCE = 1e-7
#: Least and largest length of a step.
LEAST_RADIUS, MOST_RADIUS = 1e-9, 4.0
#: Groups that one task of a step sums; small partitions of the groups are read together.
GROUPS_PER_TASK = 100_000


class Params(NamedTuple):
    alpha1: float
    beta1: float
    alpha2: float
    beta2: float
    pi: float


class Fit(NamedTuple):
    params: Params
    pairs: float
    start_likelihood: float
    likelihood: float
    steps: int
    converged: bool


def groups(pairs: DataFrame) -> DataFrame:
    """``n, e, w``: observed count, expected count, number of pairs that have both."""
    usable = with_expected(pairs).where((F.col("expected") > 0) & F.col("a").isNotNull())
    return (
        usable.groupBy(F.col("a").cast("double").alias("n"), F.col("expected").alias("e"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )


def _from_free(theta: np.ndarray) -> Params:
    """Parameters of free ones, which are held within ``FREE_LIMIT``: beyond it a component is a point or a mixture has one component."""
    held = np.clip(theta, -FREE_LIMIT, FREE_LIMIT)
    return Params(*np.exp(held[:4]).tolist(), float(0.5 * (1 + math.tanh(held[4] / 2))))


def _log_shares(pi: float) -> tuple[float, float]:
    """Logarithms of both mixture weights; a weight that has rounded to 0 counts as the least one that has not."""
    least = math.exp(-FREE_LIMIT) / 2
    return math.log(max(pi, least)), math.log(max(1 - pi, least))


def _to_free(params: tuple) -> np.ndarray:
    return np.concatenate((np.log(params[:4]), [math.log(params[4]) - math.log1p(-params[4])]))


def scores(n: np.ndarray, e: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each pair, and its derivatives by the logarithms of the shapes and rates and the logit of the weight."""
    return _derivatives(n, e, np.ones(len(n)), params)[:2]


def _derivatives(n: np.ndarray, e: np.ndarray, w: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``scores``, and the second derivatives of the likelihood of all pairs, ``w`` times each.

    Within a component a count is negative binomial. A mixture's derivative by a
    component's parameter is that of the component times the posterior share of it;
    the second ones add the spread of the first ones between the components.
    """
    zero, one = np.zeros(len(n)), np.ones(len(n))
    parts, slopes, bends = [], [], []
    logs = _log_shares(params.pi)
    for alpha, beta, log_share in ((params.alpha1, params.beta1, logs[0]), (params.alpha2, params.beta2, logs[1])):
        near, shape = np.log(beta) - np.log(beta + e), np.array(alpha)
        parts.append(log_share + G.lgamma(n + alpha) - G.lgamma(shape) - G.lgamma(n + 1.0) + alpha * near + n * (np.log(e) - np.log(beta + e)))
        by_shape = alpha * (G.digamma(n + alpha) - G.digamma(shape) + near)
        slopes.append([by_shape, alpha - (n + alpha) * beta / (beta + e)])
        bends.append(
            (by_shape + alpha**2 * (G.trigamma(n + alpha) - G.trigamma(shape)), alpha * e / (beta + e), -(n + alpha) * beta * e / (beta + e) ** 2)
        )
    total = np.logaddexp(*parts)
    held = [np.exp(part - total) for part in parts]
    within = [
        np.stack([*slopes[0], zero, zero, one - params.pi], axis=1),
        np.stack([zero, zero, *slopes[1], zero - params.pi], axis=1),
    ]
    slope = held[0][:, None] * within[0] + held[1][:, None] * within[1]
    curve = -(slope * w[:, None]).T @ slope
    for k in range(2):
        share, at = w * held[k], 2 * k
        curve += (within[k] * share[:, None]).T @ within[k]
        shapes, both, rates = (share @ bend for bend in bends[k])
        curve[at : at + 2, at : at + 2] += [[shapes, both], [both, rates]]
    curve[4, 4] -= params.pi * (1 - params.pi) * w.sum()
    return total, slope, curve


def _sums(table: DataFrame, points: list[Params]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Likelihood, gradient and second derivatives over all groups at each of the points, one aggregation."""
    size = 31 * len(points)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(points), 31))
        for batch in batches:
            n, e, w = (batch.column(i).to_numpy() for i in range(3))
            for at, params in enumerate(points):
                value, slope, curve = _derivatives(n, e, w, params)
                out[at] += np.concatenate(([w @ value], w @ slope, curve.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out.ravel())], ["at", "value"])

    rows = table.select("n", "e", "w").mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["at"]] = r["value"]
    return [(sums[0], sums[1:6], sums[6:].reshape(5, 5)) for sums in out.reshape(-1, 31)]


def _newton(slope: np.ndarray, curve: np.ndarray, radius: float) -> np.ndarray:
    """The move of at most this length that promises most by slope and curvature.

    Where the likelihood bends up in some direction, or the full step is longer,
    the damping that gives a step of just this length is found by bisection.
    """
    bend, axes = np.linalg.eigh(-curve)
    along = axes.T @ slope

    def damped(by: float) -> np.ndarray:
        return along / np.maximum(bend + by, 1e-300)

    if bend[0] > 0 and np.linalg.norm(damped(0.0)) <= radius:
        return axes @ damped(0.0)
    low = max(0.0, -bend[0])
    high = low + np.linalg.norm(slope) / radius
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if np.linalg.norm(damped(middle)) > radius else (low, middle)
    move = damped(high)
    left = radius**2 - move @ move
    if bend[0] <= 0 and left > 0:  # no slope along the upward bend: go along it
        move[0] += math.copysign(math.sqrt(left + move[0] ** 2) - abs(move[0]), move[0])
    return axes @ move


def _within(theta: np.ndarray, slope: np.ndarray, curve: np.ndarray, radius: float) -> np.ndarray:
    """The step among the parameters that it does not drive over the limits that they have reached."""
    inside = np.ones(len(theta), bool)
    while True:
        move, free = np.zeros(len(theta)), np.flatnonzero(inside)
        if len(free):
            move[free] = _newton(slope[free], curve[np.ix_(free, free)], radius)
        over = (theta >= FREE_LIMIT) & (move > 0) | (theta <= -FREE_LIMIT) & (move < 0)
        if not over.any():
            return move
        inside &= ~over


def _to_limit(theta: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Where the move leads, or where it first meets a limit."""
    room = np.where(move > 0, FREE_LIMIT - theta, -FREE_LIMIT - theta)
    part = np.divide(room, move, out=np.full(len(theta), np.inf), where=move != 0)
    first = part.min()
    if first > 1.0:
        return theta + move
    return np.clip(np.where(part == first, np.sign(move) * FREE_LIMIT, theta + first * move), -FREE_LIMIT, FREE_LIMIT)


class _Search:
    """One way up from one start: Newton steps in free parameters, which ``frame`` turns into the five.

    The radius grows where the likelihood rises as promised and shrinks where it does
    not. A step ends at the first limit that it meets; from there the parameter is held
    as long as it pushes outwards. Converged means that not even a step of length one
    (in logarithms) promises a gain.
    """

    def __init__(self, at: np.ndarray, frame: np.ndarray, sums: tuple, tolerance: float) -> None:
        self.at, self.frame, self.tolerance = at, frame, tolerance
        self.value, self.slope, self.curve = sums
        self.radius, self.converged = 1.0, False

    def params(self) -> Params:
        return _from_free(self.frame @ self.at)

    def propose(self) -> Params | None:
        """Where to go next, nothing when the search is over."""
        if self.converged or self.radius <= LEAST_RADIUS:
            return None
        slope, curve = self.frame.T @ self.slope, self.frame.T @ self.curve @ self.frame
        promise = lambda move: slope @ move + move @ curve @ move / 2
        move = _within(self.at, slope, curve, max(self.radius, 1.0))
        if promise(move) <= self.tolerance:
            self.converged = True
            return None
        if self.radius < 1.0:
            move = _within(self.at, slope, curve, self.radius)
        self.to = _to_limit(self.at, move)
        self.length, self.promised = np.linalg.norm(self.to - self.at), promise(self.to - self.at)
        return _from_free(self.frame @ self.to)

    def accept(self, sums: tuple) -> None:
        """Go there if the likelihood has risen."""
        noise = 1e-11 * abs(self.value)
        kept = (sums[0] - self.value + noise) / (self.promised + noise) if np.isfinite(sums[0]) else -1.0
        if kept < 0.25:
            self.radius = self.length / 4
        elif kept > 0.75:
            self.radius = min(MOST_RADIUS, max(self.radius, 2 * self.length))
        if kept > 1e-4:
            self.at = self.to
            self.value, self.slope, self.curve = sums


def maximise(pairs: DataFrame, start: tuple = K.MGPS_START) -> Fit:
    """Maximum likelihood; tells whether the search that won converged.

    Three searches go up side by side: from ``start``; from a wide and a narrow component
    around the mean ratio of observed to expected; and with both components held equal.
    The likelihood has more than one peak, the higher one wins. Equal components win
    unless two gain more than their three further parameters are worth (half the
    logarithm of the number of pairs each): a weak second one follows noise.
    """
    table = groups(pairs).persist()
    try:
        facts = table.agg(F.count("w"), F.sum("w"), F.sum(F.col("w") * F.col("n")), F.sum(F.col("w") * F.col("e"))).first()
        distinct, count, seen, due = (v or 0.0 for v in facts)
        parts = table.coalesce(math.ceil(distinct / GROUPS_PER_TASK) or 1)
        ratio = seen / due if seen and due else 1.0
        one, tied = np.eye(5), np.zeros((5, 2))
        tied[[0, 1, 2, 3], [0, 1, 0, 1]] = 1.0
        begin = [(_to_free(start), one), (_to_free((1.0, 1.0 / ratio, 100.0, 100.0 / ratio, 0.5)), one), (np.array([0.0, -math.log(ratio)]), tied)]
        begin = [(np.clip(at, -FREE_LIMIT, FREE_LIMIT), frame) for at, frame in begin]
        sums = _sums(parts, [_from_free(frame @ at) for at, frame in begin])
        searches = [_Search(at, frame, s, TOLERANCE * max(count, 1.0)) for (at, frame), s in zip(begin, sums)]
        begun, step = searches[0].value, 0
        while step < MAX_STEPS:
            step += 1
            going = [(search, to) for search in searches if (to := search.propose()) is not None]
            if not going:
                break
            for (search, _), found in zip(going, _sums(parts, [to for _, to in going])):
                search.accept(found)
        *two, equal = searches
        best = max(two, key=lambda search: search.value)
        if best.value - equal.value <= 1.5 * math.log(max(count, 1.0)):
            best = equal
        return Fit(best.params(), count, float(begun), float(best.value), step, best.converged)
    finally:
        table.unpersist()


def fit(pairs: DataFrame, start: tuple = K.MGPS_START) -> Params:
    """Hyper-parameters over all pairs with a positive expected count; fails if the search did not converge."""
    found = maximise(pairs, start)
    if not found.converged:
        raise RuntimeError(f"the shrinkage fit did not converge: {found}")
    return found.params


def _component(n: Column, e: Column, alpha: float, beta: float) -> Column:
    """Log probability of n without the term that depends on n alone."""
    shape = F.lit(alpha)
    return lgamma(shape + n) - lgamma(shape) + alpha * F.log(beta / (beta + e)) + n * F.log(e / (beta + e))


def with_posterior(pairs: DataFrame, params: Params) -> DataFrame:
    """Posterior mixture per pair: weight ``_q``, shapes and rates of both components."""
    n = F.col("a").cast("double")
    df = with_expected(pairs).withColumn("_e", F.when((F.col("a") > 0) & (F.col("expected") > 0), F.col("expected")))
    e = F.col("_e")
    first, second = _log_shares(params.pi)
    log_odds = second + _component(n, e, params.alpha2, params.beta2) - first - _component(n, e, params.alpha1, params.beta1)
    return df.withColumns(
        {
            "_q": 1.0 / (1.0 + F.exp(log_odds)),
            "_s1": n + params.alpha1, "_r1": e + params.beta1,
            "_s2": n + params.alpha2, "_r2": e + params.beta2,
        }
    )


def with_ebgm(pairs: DataFrame, params: Params, keep_posterior: bool = False) -> DataFrame:
    """Posterior geometric mean of the reporting ratio, NULL for empty cells."""
    df = with_posterior(pairs, params).withColumn("_shapes", F.array("_s1", "_s2"))
    df = df.withColumn("_psi", over_all(DIGAMMA_BODY, "_shapes"))
    q = F.col("_q")
    mean = q * (F.col("_psi")[0] - F.log("_r1")) + (1.0 - q) * (F.col("_psi")[1] - F.log("_r2"))
    df = df.withColumn("EBGM", F.exp(mean)).drop("_psi", "_shapes", "_e")
    return df if keep_posterior else df.drop("_q", "_s1", "_r1", "_s2", "_r2")


_BOUNDS = T.StructType([T.StructField("EB05", T.DoubleType()), T.StructField("EB95", T.DoubleType())])


@F.pandas_udf(_BOUNDS)
def _bounds(q: pd.Series, s1: pd.Series, r1: pd.Series, s2: pd.Series, r2: pd.Series) -> pd.DataFrame:
    table = np.column_stack([v.to_numpy(dtype=float) for v in (q, s1, r1, s2, r2)])
    out = np.full((len(table), 2), np.nan)
    ok = np.isfinite(table).all(axis=1)
    if ok.any():
        columns = [np.ascontiguousarray(c) for c in table[ok].T]
        out[ok, 0] = G.mixture_quantile(0.05, *columns)
        out[ok, 1] = G.mixture_quantile(0.95, *columns)
    return pd.DataFrame(out, columns=["EB05", "EB95"])


def with_mgps(pairs: DataFrame, params: Params) -> DataFrame:
    """``expected, EBGM, EB05, EB95``; the bounds are vectorised in Arrow batches."""
    df = with_ebgm(pairs, params, keep_posterior=True)
    df = df.withColumn("_b", _bounds("_q", "_s1", "_r1", "_s2", "_r2"))
    bound = lambda c: F.when(F.col("EBGM").isNotNull(), F.nanvl(F.col(f"_b.{c}"), F.lit(None).cast("double")))
    return df.withColumns({"EB05": bound("EB05"), "EB95": bound("EB95")}).drop("_b", "_q", "_s1", "_r1", "_s2", "_r2")


def round_mgps(df: DataFrame) -> DataFrame:
    return df.withColumns({c: round4(F.col(c)) for c in ("expected", "EBGM", "EB05", "EB95") if c in df.columns})


def screening_share(df: DataFrame, bar: float = 2.0) -> DataFrame:
    """Pairs whose EB05 passes the screening bar, and their share."""
    hit = F.coalesce(F.col("EB05") > bar, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(hit).alias("passing"), F.avg(hit.cast("double")).alias("share"))
