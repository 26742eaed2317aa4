"""Log-gamma, digamma and trigamma as column expressions.

Spark has none of the three. Each is the asymptotic series evaluated ten units
to the right of the argument and brought back by the recurrence, which keeps the
whole computation in generated JVM code. Valid for positive arguments.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 10


def _horner(x: Column, coefficients: list[float]) -> Column:
    """c0 + x*(c1 + x*(c2 + ...))."""
    return reduce(lambda acc, c: F.lit(c) + x * acc, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _body(first: str, tail: list[float], last: str) -> str:
    """SQL text of the shifted series for ``x`` with z = x + 10 and t = x(x + 9)."""
    z, t = f"(x + {_SHIFT}D)", "(x * (x + 9D))"
    inv2 = f"(1D / ({z} * {z}))"
    poly = reduce(lambda acc, c: f"({c!r}D + {inv2} * {acc})", reversed(tail[:-1]), f"{tail[-1]!r}D")
    back = [f"(1D / ({t} + {i * (_SHIFT - 1 - i)}D))" for i in range(_SHIFT // 2)]
    sums = " + ".join(back)
    squares = " + ".join(f"{u} * {u}" for u in back)
    return (first + last).format(z=z, inv2=inv2, poly=poly, sums=f"({sums})", squares=f"({squares})", s="(2D * x + 9D)")


DIGAMMA_BODY = _body("ln({z}) - 0.5D / {z} - {inv2} * {poly}", [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132], " - {s} * {sums}")
TRIGAMMA_BODY = _body(
    "1D / {z} + 0.5D * {inv2} + {inv2} / {z} * {poly}", [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66],
    " + {s} * {s} * {squares} - 2D * {sums}",
)


def over_all(body: str, array_column: str) -> Column:
    """The function of every entry of an array column.

    The body is planned once instead of once per argument, which keeps the
    generated code of wide formulas small enough to be compiled.
    """
    return F.expr(f"transform({array_column}, x -> {body})")


def lgamma(x: Column) -> Column:
    z = x + float(_SHIFT)
    inv2 = 1.0 / (z * z)
    tail = _horner(inv2, [1 / 12, -1 / 360, 1 / 1260, -1 / 1680])
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail / z
    # Two products of five keep the intermediate far from overflow.
    steps = [x + float(i) for i in range(_SHIFT)]
    low = reduce(lambda p, q: p * q, steps[:5])
    high = reduce(lambda p, q: p * q, steps[5:])
    return stirling - F.log(low) - F.log(high)


def log_add(x: Column, y: Column) -> Column:
    """log(exp(x) + exp(y)) without overflow."""
    top = F.greatest(x, y)
    return top + F.log1p(F.exp(F.least(x, y) - top))


def round4(x: Column) -> Column:
    """Four decimals, ties to even on the scaled binary value."""
    return F.rint(x * 10000.0) / 10000.0
