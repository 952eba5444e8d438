"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-F.pow((x - mean) / sd, F.lit(2.0)) / 2) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution by Abramowitz and Stegun's formula 7.1.26."""
    # The formula's coefficients.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    z = F.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + p * z)
    y = 1.0 - (((((a5 * t + a4) * t) + a3) * t + a2) * t + a1) * t * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -1.0).otherwise(1.0) * y)


def entropy(counts: Column) -> Column:
    """Shannon entropy in nats of an array of counts."""
    n = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log(c / n))


def split_score(labels: Column) -> Column:
    """Where an array of 0 and 1 is best cut in two: the index i (from 0) that maximises the larger
    class up to i plus the larger class after it; the last of equals wins, -1 for an empty array."""
    n, ones = F.size(labels), F.aggregate(labels, F.lit(0), lambda a, x: a + x)
    seen = F.aggregate(
        labels,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("one"), F.lit(-1).alias("best"), F.lit(-1).alias("at")),
        lambda a, x: _split_step(a, x, n, ones),
    )
    return seen["at"]


def _split_step(a: Column, x: Column, n: Column, ones: Column) -> Column:
    one = a["one"] + x
    left, right = a["i"] + 1, n - a["i"] - 1
    score = F.greatest(one, left - one) + F.greatest(ones - one, right - (ones - one))
    better = score >= a["best"]
    return F.struct(left.alias("i"), one.alias("one"), F.when(better, score).otherwise(a["best"]).alias("best"), F.when(better, a["i"]).otherwise(a["at"]).alias("at"))
