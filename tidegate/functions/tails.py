"""Tail probabilities as column expressions.

They are applied to aggregated rows (one per test), so a fixed number of series
terms per row costs nothing, and no Python worker is started.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper quantiles of the standard normal: 95 %, 80 %, 90 %, 97.5 %.
Z_95 = 1.6448536269514722
Z_80 = 0.8416212335729143
Z_90 = 1.2815515655446004
Z_975 = 1.96

_SQRT_2PI = math.sqrt(2 * math.pi)


def normal_sf(z: Column) -> Column:
    """P(Z > z): power series in the middle, continued fraction in the tails."""
    a = F.abs(z.cast("double"))
    density = F.exp(-a * a / 2) / _SQRT_2PI
    inner = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda s, k: F.struct(
            (s["term"] * a * a / (2 * k + 1)).alias("term"),
            (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total"),
        ),
        lambda s: 0.5 - density * s["total"],
    )
    outer = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc,
        lambda acc: density / acc,
    )
    upper = F.when(a < 3, inner).otherwise(outer)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def normal_cdf(z: Column) -> Column:
    return normal_sf(-z)


def normal_two_sided(z: Column) -> Column:
    return 2 * normal_sf(F.abs(z))


def student_sf(t: Column, df: Column) -> Column:
    """P(T > t) for an integer number of degrees of freedom >= 1.

    Uses the finite trigonometric sum for the central probability, whose length
    is half the degrees of freedom.
    """
    nu = df.cast("long")
    ratio = F.abs(t.cast("double")) / F.sqrt(nu.cast("double"))
    theta = F.atan(ratio)
    cos2 = 1 / (1 + ratio * ratio)
    odd = (nu % 2) == 1
    first = F.when(odd, F.sqrt(cos2)).otherwise(F.lit(1.0))
    start = F.when(odd, 1).otherwise(0)
    # terms follow t_{j+1} = t_j * cos2 * (2j + even?1:2) / (2j + even?2:3)
    steps = F.greatest(F.floor((nu - 2 - start) / 2), F.lit(0)).cast("int")
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("total")),
        lambda s, j: F.struct(
            (s["term"] * cos2 * (2 * j - 1 + start) / (2 * j + start)).alias("term"),
            (s["total"] + s["term"] * cos2 * (2 * j - 1 + start) / (2 * j + start)).alias("total"),
        ),
        lambda s: s["total"],
    )
    sin = F.sin(theta)
    central = (
        F.when(nu == 1, theta * (2 / math.pi))
        .when(odd, (theta + sin * total) * (2 / math.pi))
        .otherwise(sin * total)
    )
    upper = F.greatest((1 - central) / 2, F.lit(0.0))
    return F.when(t >= 0, upper).otherwise(1 - upper)


def student_two_sided(t: Column, df: Column) -> Column:
    return 2 * student_sf(F.abs(t), df)
