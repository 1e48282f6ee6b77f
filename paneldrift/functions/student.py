"""Student's t distribution with whole degrees of freedom, as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ColumnLike, col

#: Above this the quantile's expansion in 1 / dof is exact to double precision, near enough.
MANY = 200
#: Probabilities beyond take the distribution with this many degrees of freedom.
MOST = 10_000
NEWTON_STEPS = 40


def _factors(last: Column) -> Column:
    """1, 2, ..., last; empty for last < 1."""
    some = F.sequence(F.lit(1).cast("bigint"), F.greatest(last, F.lit(1).cast("bigint")))
    return F.when(last >= 1, some).otherwise(F.array().cast("array<bigint>"))


def t_within(t: ColumnLike, dof: ColumnLike) -> Column:
    """P(-t < T < t) for t >= 0, from the finite series for whole degrees of freedom.

    With tan(a) = t / sqrt(dof) the series runs over powers of cos(a)^2, each factor one step of an
    aggregate: (2k - 1) / 2k for an even dof, 2k / (2k + 1) for an odd one.
    """
    t, v = col(t).cast("double"), F.least(col(dof).cast("bigint"), F.lit(MOST))
    odd = v % 2
    square = v / (v + t * t)
    sine, cosine = t / F.sqrt(v + t * t), F.sqrt(square)

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * square * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    one = F.expr("nullif(1D, 0D)")
    start = F.struct(one.alias("term"), one.alias("total"))
    series = F.aggregate(_factors(F.floor((v - 2 - odd) / 2)), start, step, lambda s: s["total"])
    angle = F.atan2(t, F.sqrt(v.cast("double")))
    whole = F.when(v == 1, angle).otherwise(angle + sine * cosine * series) * (2 / math.pi)
    return F.when(col(dof) >= 1, F.when(odd == 1, whole).otherwise(sine * series))


def t_density(t: ColumnLike, dof: ColumnLike) -> Column:
    """Density at t; its constant is a finite product for whole degrees of freedom.

    G(dof) = gamma((dof + 1) / 2) / gamma(dof / 2) grows by (dof + 1) / dof from dof to dof + 2.
    """
    t, v = col(t).cast("double"), col(dof).cast("bigint")
    odd = v % 2
    first = F.when(odd == 1, 1 / math.sqrt(math.pi)).otherwise(math.sqrt(math.pi) / 2)
    factors = _factors(F.floor((v - 2 + odd) / 2))
    gammas = F.aggregate(factors, first, lambda g, k: g * (2 * k - odd + 1) / (2 * k - odd))
    power = F.pow(1 + t * t / v, -(v + 1) / 2)
    return F.when(v >= 1, gammas / F.sqrt(v * math.pi) * power)


def t_quantile(level: float, dof: ColumnLike) -> Column:
    """t with P(-t < T < t) = level, NULL for less than one degree of freedom.

    An expansion around the normal quantile in powers of 1 / dof; for up to MANY degrees of freedom
    Newton's method goes on from there. The probability is concave in t, so the first step can only
    fall short of the root or land on its lower side, and the following ones rise to it.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    v = col(dof).cast("double")
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    expansion = F.lit(z)
    for i, c in enumerate(terms, 1):
        expansion = expansion + F.lit(c) / F.pow(v, F.lit(float(i)))

    def closer(t: Column, _: Column) -> Column:
        return t - (t_within(t, dof) - level) / (2 * t_density(t, dof))

    steps = F.sequence(F.lit(1), F.lit(NEWTON_STEPS))
    # from the normal quantile, which is below the root
    root = F.aggregate(steps, F.expr(f"nullif({z!r}D, -1D)"), closer)
    return F.when(v > MANY, expansion).when(v >= 1, root)
