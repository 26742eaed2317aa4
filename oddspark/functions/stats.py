"""Disproportionality measures on 2x2 cells ``a, b, c, d, N``.

Undefined values are NULL, never NaN. Gates and tiers use unrounded values;
``round_measures`` is applied last, for output only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark import constants as K
from oddspark.functions.special import DIGAMMA_BODY, TRIGAMMA_BODY, over_all, round4

MEASURES = ["ROR", "ROR_lower", "ROR_upper", "PRR", "chi2", "IC", "IC025", "IC975"]
_LN2 = math.log(2.0)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _cells() -> tuple[Column, Column, Column, Column]:
    return _d("a"), _d("b"), _d("c"), _d("d")


def _pearson(a: Column, b: Column, c: Column, d: Column, n: Column) -> Column:
    diff = a * d - b * c
    return diff * diff * n / ((a + b) * (c + d) * (a + c) * (b + d))


def _interval(df: DataFrame, ok: Column, se: Column) -> DataFrame:
    """Add ROR_lower and ROR_upper from ROR where its logarithm exists."""
    log_ror = F.log("ROR")
    usable = ok & (F.col("ROR") > 0)
    return df.withColumns(
        {
            "ROR_lower": F.when(usable, F.exp(log_ror - K.Z95 * se)),
            "ROR_upper": F.when(usable, F.exp(log_ror + K.Z95 * se)),
        }
    )


def with_ratios(df: DataFrame) -> DataFrame:
    """ROR with interval, PRR and chi-squared, NULL unless b, c and d are positive."""
    a, b, c, d = _cells()
    ok = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    df = df.withColumns(
        {
            "ROR": F.when(ok, (a * d) / (b * c)),
            "PRR": F.when(ok, (a / (a + b)) / (c / (c + d))),
            "chi2": F.when(ok, _pearson(a, b, c, d, _d("N"))),
        }
    )
    return _interval(df, ok, F.sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d))


def with_single_ror(df: DataFrame) -> DataFrame:
    """Single-pair odds ratio: NULL only if b or c is 0; a and d guarded in the error term."""
    a, b, c, d = _cells()
    ok = (F.col("b") > 0) & (F.col("c") > 0)
    df = df.withColumn("ROR", F.when(ok, (a * d) / (b * c)))
    se = F.sqrt(1.0 / F.greatest(a, F.lit(1.0)) + 1.0 / b + 1.0 / c + 1.0 / F.greatest(d, F.lit(1.0)))
    return _interval(df, ok, se)


def with_single_ratios(df: DataFrame) -> DataFrame:
    """``with_single_ror`` plus PRR and chi-squared with their own zero guards."""
    a, b, c, d = _cells()
    margins = (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0)
    cols = (F.col("a") + F.col("c") > 0) & (F.col("b") + F.col("d") > 0)
    return with_single_ror(df).withColumns(
        {
            "PRR": F.when(margins & (F.col("c") > 0), (a / (a + b)) / (c / (c + d))),
            "chi2": F.when(margins & cols, _pearson(a, b, c, d, a + b + c + d)),
        }
    )


def with_bcpnn(df: DataFrame) -> DataFrame:
    """Information component with its 95 % credible interval (beta priors, closed form)."""
    a, b, c, d = _cells()
    n = a + b + c + d
    p1 = 1.0 + a + b
    q1 = 1.0 + a + c
    both = 2.0 + n  # p1 + p2 and q1 + q2 alike
    r1 = 1.0 + a
    r2 = n - a - 1.0 + both * both / (q1 * p1)
    df = df.withColumn("_args", F.array(r1, r1 + r2, p1, q1, both))
    df = df.withColumns({"_psi": over_all(DIGAMMA_BODY, "_args"), "_tri": over_all(TRIGAMMA_BODY, "_args")})
    psi = [F.col("_psi")[i] for i in range(5)]
    tri = [F.col("_tri")[i] for i in range(5)]
    mean = (psi[0] - psi[1] - psi[2] - psi[3] + 2.0 * psi[4]) / _LN2
    var = (tri[0] - tri[1] + tri[2] + tri[3] - 2.0 * tri[4]) / (_LN2 * _LN2)
    half = K.Z95 * F.sqrt(F.greatest(var, F.lit(0.0)))
    present = F.col("a") > 0
    df = df.withColumns({"_ic": F.when(present, mean), "_half": F.when(present, half)})
    # As a one-row generator the interval is a barrier for filters: a condition on the
    # tier is applied to the finished columns instead of repeating the series below.
    interval = F.struct(
        F.col("_ic").alias("IC"), (F.col("_ic") - F.col("_half")).alias("IC025"), (F.col("_ic") + F.col("_half")).alias("IC975")
    )
    return df.select("*", F.inline(F.array(interval))).drop("_ic", "_half", "_psi", "_tri", "_args")


def tier(ic025: Column, a: Column) -> Column:
    return (
        F.when(a < K.MIN_REPORTS, "none")
        .when(ic025 > K.TIER_STRONG, "strong")
        .when(ic025 > K.TIER_MODERATE, "moderate")
        .when(ic025 > K.TIER_WEAK, "weak")
        .otherwise("none")
    )


def tier_rank(name: Column) -> Column:
    """0 none, 1 weak, 2 moderate, 3 strong; anything else 0."""
    rank = F.lit(0)
    for i, label in enumerate(K.TIERS):
        rank = F.when(name == label, i).otherwise(rank)
    return rank


def with_gates(df: DataFrame) -> DataFrame:
    """Screening flag and evidence tier."""
    return df.withColumns(
        {
            "signal": F.coalesce((F.col("a") >= K.MIN_REPORTS) & (F.col("ROR_lower") > 1.0), F.lit(False)),
            "tier": tier(F.col("IC025"), F.col("a")),
        }
    )


def with_expected(df: DataFrame) -> DataFrame:
    a, b, c, _ = _cells()
    return df.withColumn("expected", (a + b) * (a + c) / _d("N"))


def round_measures(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = [c for c in (columns or MEASURES) if c in df.columns]
    return df.withColumns({c: round4(F.col(c)) for c in names})
