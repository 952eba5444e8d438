"""Interval algebra on closed, 1-based intervals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_STRAND = "?"


def overlaps(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return (l1 <= r2) & (l2 <= r1)


def strands_agree(s1: Column, s2: Column) -> Column:
    """Equal strands; an unknown one agrees with every strand."""
    return (s1 == s2) | (s1 == UNKNOWN_STRAND) | (s2 == UNKNOWN_STRAND)


def contains(l1: Column, r1: Column, l2: Column, r2: Column, slack: int = 0) -> Column:
    """The first interval, longer by ``slack`` on both sides, holds the second."""
    return (l1 - slack <= l2) & (r2 <= r1 + slack)


def properly_contains(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return ((l1 < l2) & (r2 <= r1)) | ((l1 <= l2) & (r2 < r1))


def overlap_length(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Shared positions."""
    return F.greatest(F.least(r1, r2) - F.greatest(l1, l2) + 1, F.lit(0))


def overlap_span(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Distance between the shared ends: one less than ``overlap_length``."""
    return F.greatest(F.least(r1, r2) - F.greatest(l1, l2), F.lit(0))


def overlap_length_or_fail(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return F.when(overlaps(l1, r1, l2, r2), overlap_length(l1, r1, l2, r2)).otherwise(F.raise_error(F.lit("intervals don't overlap")).cast("long"))


def length(left: Column, right: Column) -> Column:
    return right - left + 1


def normalised(left: Column, right: Column) -> Column:
    """struct(left, right) with the ends in order."""
    return F.struct(F.least(left, right).alias("left"), F.greatest(left, right).alias("right"))


def to_half_open(left: Column, right: Column) -> Column:
    return F.struct(left.alias("start"), (right + 1).alias("stop"))


def before_group(left: Column, right: Column, group_left: Column, radius: int) -> Column:
    """The interval ends more than ``radius`` before the group starts."""
    return right + radius < group_left


def after_group(left: Column, group_right: Column, radius: int) -> Column:
    return left > group_right + radius


def contains_on_strand(l1: Column, r1: Column, s1: Column, l2: Column, r2: Column, s2: Column) -> Column:
    """The first interval holds the second, and their strands agree."""
    return contains(l1, r1, l2, r2) & strands_agree(s1, s2)


def overlaps_on_strand(l1: Column, r1: Column, s1: Column, l2: Column, r2: Column, s2: Column) -> Column:
    return overlaps(l1, r1, l2, r2) & strands_agree(s1, s2)


def overlaps_directed(l1: Column, r1: Column, s1: Column, l2: Column, r2: Column, s2: Column) -> Column:
    """Overlap on one and the same strand; unknown is a strand of its own."""
    return overlaps(l1, r1, l2, r2) & (s1 == s2)


def equal_on_strand(l1: Column, r1: Column, s1: Column, l2: Column, r2: Column, s2: Column) -> Column:
    return (l1 == l2) & (r1 == r2) & strands_agree(s1, s2)


def match_length(left: Column, length: Column, start: Column, stop: Column) -> Column:
    """Positions of a feature inside [start, stop), with the half-open reading of its right end.

    A feature that goes on beyond ``stop`` counts up to it, one that ends within counts whole, or from ``start`` on.
    """
    end, inside = left + length, (left + length > start) & (left < stop)
    within = end <= stop + 1
    part = F.when(left > start, F.when(within, length).otherwise(stop - left)).otherwise(F.when(within, end - start).otherwise(stop - start))
    return F.when(inside, part).otherwise(0)


def near_group(left: Column, right: Column, group_left: Column, group_right: Column, radius: int) -> Column:
    """Neither before the group nor after it."""
    return ~before_group(left, right, group_left, radius) & ~after_group(left, group_right, radius)


def merge_features(features: Column) -> Column:
    """Adjacent features of one code (right + 1 = next left) become one; the first's coverage stays.

    features: array<struct<code,left,right,avg_cov>> in order.
    """
    start = F.slice(features, 1, 1)

    def step(done: Column, f: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["code"].alias("code"), last["left"].alias("left"), f["right"].alias("right"), last["avg_cov"].alias("avg_cov"))
        touch = (last["code"] == f["code"]) & (last["right"] + 1 == f["left"])
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(f)))

    return F.when(F.size(features) == 0, features).otherwise(F.aggregate(F.slice(features, 2, F.greatest(F.size(features) - 1, F.lit(0))), start, step))


def intron_subset(small: Column, large: Column) -> Column:
    """Every intron of the one is an intron of the other."""
    return F.size(F.array_except(small, large)) == 0
