"""Exon segments of a locus from its coverage and junctions.

The rules work on lists of runs, junctions and segments, so that one grouped call per locus holds what
is left after coverage and junctions were summed: its distinct changes of depth, not its reads.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Range = tuple[int, int]
#: Distance of two covered runs, from the end of one to the start of the next, below which a gap is closed.
FREE, CROSSED = 30, 10


def islands(runs: list[Range]) -> list[Range]:
    """Maximal covered runs of ranges in order."""
    out: list[Range] = []
    for a, b in runs:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def fill_gaps(covered: list[Range], junctions: list[Range], free: int = FREE, crossed: int = CROSSED) -> list[Range]:
    """Short gaps between covered runs are closed: shorter ones where a junction crosses but none fits."""
    out = covered[:1]
    for left, right in covered[1:]:
        head = out[-1][1]
        over = [j for j in junctions if j[0] <= left and head <= j[1]]
        if left - head < (crossed if over else free) and (head + 1, left - 1) not in over:
            out[-1] = (out[-1][0], right)
        else:
            out.append((left, right))
    return out


def split_segments(covered: list[Range], junctions: list[Range]) -> list[Range]:
    """Covered runs cut where junctions start and end; pieces of one position are left out."""
    cuts = sorted({start for start, _ in junctions} | {stop + 1 for _, stop in junctions})
    pieces = []
    for left, right in covered:
        at = [left, *cuts[bisect_right(cuts, left) : bisect_right(cuts, right)], right + 1]
        pieces += [(a, b - 1) for a, b in zip(at, at[1:]) if b - a > 1]
    return pieces


class Depth:
    """Sums of depth over ranges, from runs (left, right, depth) in order that don't overlap."""

    def __init__(self, runs: list[tuple[int, int, float]]):
        self.starts = [a for a, _, _ in runs]
        self.runs = runs
        self.before = [0.0, *accumulate((b - a + 1) * d for a, b, d in runs)]

    def up_to(self, at: int) -> float:
        """Summed depth of the positions up to ``at``."""
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return 0.0
        a, b, d = self.runs[k]
        return self.before[k] + (min(at, b) - a + 1) * d

    def total(self, left: int, right: int) -> float:
        return self.up_to(right) - self.up_to(left - 1)


def drop_low(segments: list[Range], depth: Depth, junctions: dict[Range, float], fraction: float) -> list[Range]:
    """Segments without those too thin beside the junctions over them, or beside the median of the thick ones.

    A segment's depth leaves its last position out.  Thick is what no junction over it exceeds.
    """
    cover = [depth.total(a, b - 1) / (b - a) for a, b in segments]
    over = [max((n for (c, d), n in junctions.items() if c <= b and a <= d), default=0.0) for a, b in segments]
    thick = [c for c, n in zip(cover, over) if c > n]
    least = median(thick) if thick else 0.0
    return [s for s, c, n in zip(segments, cover, over) if not (c < n * fraction or c < least * fraction)]


def drop_unsupported(segments: list[Range], junctions: list[Range]) -> list[Range]:
    """Segments without those that no junction joins to another segment and that don't touch all their neighbours."""
    starts, stops = [a for a, _ in segments], [b for _, b in segments]
    leaving: dict[int, int] = {}
    coming: dict[int, int] = {}
    for a, b in sorted(junctions):
        leaving.setdefault(a, b)
        coming.setdefault(b, a)

    def held(values: list[int], x: int) -> bool:
        k = bisect_left(values, x)
        return k < len(values) and values[k] == x

    out = []
    for k, (a, b) in enumerate(segments):
        joined = (b + 1 in leaving and held(starts, leaving[b + 1] + 1)) or (a - 1 in coming and held(stops, coming[a - 1] - 1))
        touches = (k == 0 or segments[k - 1][1] + 1 == a) and (k == len(segments) - 1 or b + 1 == segments[k + 1][0])
        if joined or touches or len(segments) == 1:
            out.append((a, b))
    return out


def of_locus(runs: list[tuple[int, int, float]], junctions: dict[Range, float], fraction: float) -> tuple[list[tuple[int, int, float]], list[Range]]:
    """Segments (left, right, mean depth) and the junctions between them.

    Several covered runs without a junction are no locus, and give nothing.
    """
    depth, own = Depth(runs), sorted(junctions)
    segments = fill_gaps(islands([(a, b) for a, b, _ in runs]), own)
    if not own:
        if len(segments) > 1:
            return [], []
    else:
        segments = drop_unsupported(drop_low(split_segments(segments, own), depth, junctions, fraction), own)
    starts, stops = {a for a, _ in segments}, {b for _, b in segments}
    kept = [(a, b) for a, b in own if a - 1 in stops and b + 1 in starts]
    return [(a, b, depth.total(a, b - 1) / (b - a + 1)) for a, b in segments], kept


PARTS = "locus long, kind string, left long, right long, n double"


def parts(runs: DataFrame, junctions: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Segments and junctions of each locus: kind, left, right, and n, the mean depth or the reads.

    runs: locus, left, right, depth; junctions: locus, left, right, n_reads.
    """
    rows = runs.select("locus", F.lit("run").alias("kind"), "left", "right", F.col("depth").cast("double").alias("n")).unionByName(junctions.select("locus", F.lit("junction").alias("kind"), "left", "right", F.col("n_reads").cast("double").alias("n")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["left", "right"])
        cover = list(pdf.loc[pdf["kind"] == "run", ["left", "right", "n"]].itertuples(index=False, name=None))
        own = {(a, b): n for a, b, n in pdf.loc[pdf["kind"] == "junction", ["left", "right", "n"]].itertuples(index=False, name=None)}
        found, kept = of_locus(cover, own, fraction) if cover else ([], [])
        out = [("segment", a, b, c) for a, b, c in found] + [("junction", a, b, own[a, b]) for a, b in kept]
        return pd.DataFrame([(pdf["locus"].iat[0], *x) for x in out], columns=["locus", "kind", "left", "right", "n"])

    return rows.groupBy("locus").applyInPandas(run, PARTS)
