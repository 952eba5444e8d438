"""Junctions: counts, filters by support, overlap and depth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import normal_cdf
from tessella.operators.whole import by_group

#: Least share of reads, of a dominated junction by how it overlaps the other.
FRACTION, NESTED, PARTIAL = 0.01, 1, 10
LEAST_READS, LONG, LEAST_LONG_READS = 2, 30_000, 5


def junction_counts(introns: DataFrame, group: list[str], mass: str = "mass", small: str | None = None) -> DataFrame:
    """Reads over each junction, and those of them with a small anchor."""
    agg = [F.sum(mass).alias("n_reads")]
    if small:
        agg.append(F.sum(F.when(F.col(small), F.col(mass)).otherwise(0)).alias("n_small"))
    return introns.groupBy(*group, "left", "right").agg(*agg)


def locus_strand(introns: DataFrame, group: list[str], mass: str = "mass", fraction: float = FRACTION) -> DataFrame:
    """n_plus, n_minus, the strand of the best supported junction (+ on a tie), and whether both strands are seen.

    introns: group, strand, left, right, mass; both are seen if the lesser has more than a fraction of the other's, whole.
    """
    each = introns.groupBy(*group, "strand", "left", "right").agg(F.sum(mass).alias("n")).where(F.col("strand").isin("+", "-"))
    of = lambda sign: F.coalesce(F.sum(F.when(F.col("strand") == sign, F.col("n"))), F.lit(0))
    rows = each.groupBy(*group).agg(of("+").alias("n_plus"), of("-").alias("n_minus"), F.max_by("strand", F.struct("n", (F.col("strand") == "+").alias("plus"))).alias("strand"))
    few, many = F.least("n_plus", "n_minus"), F.greatest("n_plus", "n_minus")
    return rows.withColumn("both_strands", few > F.floor(many * F.lit(fraction)))


def drop_dominated(junctions: DataFrame, group: list[str], fraction: float = FRACTION, reads: str = "n_reads", bin_width: int = 10_000) -> DataFrame:
    """Junctions without those that an overlapping one dominates.

    Of two that overlap the lesser (the earlier on a tie) goes if its share of both is below the
    fraction, or ten times that if they overlap in part.  What dominates has at least so many times the
    reads, so junctions meet only those of larger powers of that ratio, and equal ones never do.
    """
    from tessella.operators.joins import interval_join

    most = fraction * PARTIAL
    if most >= 0.5:  # then even equals may dominate each other
        weak, strong, times = junctions, junctions, 0.0
    else:
        times = (1 - most) / most if most > 0 else float("inf")
        top = junctions.groupBy(*group).agg((F.max(reads) / F.lit(times)).alias("__top"))
        low = junctions.groupBy(*group).agg((F.min(reads) * F.lit(times)).alias("__low"))
        weak = junctions.join(top, group).where(F.col(reads) <= F.col("__top")).drop("__top")
        strong = junctions.join(low, group).where(F.col(reads) >= F.col("__low")).drop("__low")
    pairs = interval_join(weak, strong, group, bin_width=bin_width).where((F.col(reads) * times <= F.col(f"b_{reads}")) & ~((F.col("left") == F.col("b_left")) & (F.col("right") == F.col("b_right"))))
    nested = ((F.col("left") <= F.col("b_left")) & (F.col("b_right") <= F.col("right"))) | ((F.col("b_left") <= F.col("left")) & (F.col("right") <= F.col("b_right")))
    earlier = (F.col("left") < F.col("b_left")) | ((F.col("left") == F.col("b_left")) & (F.col("right") < F.col("b_right")))
    lesser = (F.col(reads) < F.col(f"b_{reads}")) | ((F.col(reads) == F.col(f"b_{reads}")) & earlier)
    share = F.col(reads) / (F.col(reads) + F.col(f"b_{reads}"))
    lost = pairs.where(lesser & (share < fraction * F.when(nested, NESTED).otherwise(PARTIAL))).select(*group, "left", "right").distinct()
    return junctions.join(lost, [*group, "left", "right"], "left_anti")


def supported(reads: Column, left: Column, right: Column, small: Column | None = None, least: float = LEAST_READS) -> Column:
    """Enough reads, more of them over a long junction, and not all by small anchors."""
    long = right - left > LONG
    enough = (reads >= least) & ~(long & (reads < LEAST_LONG_READS))
    return enough if small is None else enough & (small < reads)


def anchors_by_chance(reads: Column, small: Column, anchor: int, read_length: int) -> Column:
    """Chance of so many small anchors or more, by the normal form of the binomial with a half step off."""
    p = 2.0 * anchor / read_length
    return 1 - normal_cdf((small - 0.5 - reads * p) / F.sqrt(reads * (p * (1 - p))))


def anchored_enough(reads: Column, small: Column, anchor: int, read_length: int, alpha: float) -> Column:
    """Not all reads by small anchors, and no more of those than chance allows (with an alpha of 0 always)."""
    sound = small < reads
    if alpha <= 0 or not 0 < 2 * anchor < read_length:
        return sound
    return sound & ((small < 1) | (anchors_by_chance(reads, small, anchor, read_length) >= alpha))


def inner_depth(junctions: DataFrame, runs: DataFrame, group: list[str], out: str, bin_width: int = 10_000) -> DataFrame:
    """``junctions`` with ``out``, the summed depth of ``runs`` (left, right, depth) over all but their last position."""
    from tessella.operators.joins import interval_join

    spans = junctions.select(*group, "left", F.col("right").alias("__stop"), (F.col("right") - 1).alias("right"))
    pairs = interval_join(spans, runs.select(*group, "left", "right", "depth"), group, bin_width=bin_width)
    shared = F.least("right", "b_right") - F.greatest("left", "b_left") + 1
    sums = pairs.groupBy(*group, "left", F.col("__stop").alias("right")).agg(F.sum(shared * F.col("b_depth").cast("double")).alias(out))
    return junctions.join(sums, [*group, "left", "right"], "left").fillna(0.0, [out])


def inner_median(junctions: DataFrame, runs: DataFrame, group: list[str], out: str) -> DataFrame:
    """``junctions`` with ``out``, the median depth of ``runs`` over their positions, the last of which counts as 0.

    A task works on whole groups, by ``range_medians``: junctions never meet the runs inside them as rows.
    """
    none = F.lit(None).cast("double")
    by = [*group, "left", "right"]
    rows = junctions.select(*by, none.alias("depth")).distinct().unionByName(runs.select(*by, F.col("depth").cast("double").alias("depth")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in rows.groupby(group, sort=False, dropna=False):
            is_run = own["depth"].notna().to_numpy()
            left, right, depth = (own[c].to_numpy() for c in ("left", "right", "depth"))
            j = own.loc[~is_run, by]
            found.append(j.assign(**{out: range_medians(left[~is_run], right[~is_run], left[is_run], right[is_run], depth[is_run])}))
        return pd.concat(found, ignore_index=True)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{out}` double"])
    middle = rows.dropna(subset=group).repartition(*group).sortWithinPartitions(*group).mapInPandas(by_group(group, work), schema)
    return middle if set(junctions.columns) == set(by) else junctions.join(middle, by)


def range_medians(left: np.ndarray, right: np.ndarray, run_left: np.ndarray, run_right: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The median depth over each range left to right, whose last position counts as 0; so do those outside of runs.

    Ranges and runs, which don't overlap each other, are cut at all their ends to pieces.  A wavelet matrix over the pieces'
    depths, with their lengths summed on each level, finds the values of all ranges at once, a bit of the value's rank at a time.
    """
    cuts = np.unique(np.concatenate([left, right, run_left, run_right + 1]))
    values = np.unique(np.concatenate([depth, [0.0]]))
    zero = int(np.searchsorted(values, 0.0))
    rank = np.full(max(0, len(cuts) - 1), zero)
    size = np.diff(cuts)
    first, last = np.searchsorted(cuts, run_left), np.searchsorted(cuts, run_right + 1)
    of = np.repeat(np.arange(len(depth)), last - first)
    rank[np.arange(len(of)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[of]] = np.searchsorted(values, depth)[of]
    whole = right - left + 1
    a, b = (np.tile(np.searchsorted(cuts, x), 2) for x in (left, right))
    k = np.concatenate([(whole - 1) // 2, whole // 2])  # how many positions come before the one that is looked for
    found = np.zeros(len(k), np.int64)
    with_zero = np.ones(len(k), bool)  # whether the last position, a zero, is still among the values
    for level in reversed(range(int(len(values) - 1).bit_length())):
        bit = rank >> level & 1
        low = np.concatenate([[0], np.cumsum(1 - bit)])
        weight = np.concatenate([[0], np.cumsum(np.where(bit == 0, size, 0))])
        zero_bit = zero >> level & 1
        below = weight[b] - weight[a] + (with_zero & (zero_bit == 0))
        up = k >= below
        k = np.where(up, k - below, k)
        found |= up.astype(np.int64) << level
        with_zero &= up == bool(zero_bit)
        n_low = low[-1]
        a, b = (np.where(up, n_low + x - low[x], low[x]) for x in (a, b))
        order = np.argsort(bit, kind="stable")
        rank, size = rank[order], size[order]
    return values[found].reshape(2, -1).sum(0) / 2


def deep_enough(df: DataFrame, intron_depth: str, exon_depth: str, fraction: float = FRACTION) -> DataFrame:
    """Junctions whose inside isn't covered so deeply by exonic reads that they are doubtful."""
    return df.where((F.col(exon_depth) == 0) | (F.col(intron_depth) / F.col(exon_depth) >= fraction))


def beside_exons(junctions: DataFrame, exons: DataFrame, group: list[str]) -> DataFrame:
    """Junctions that touch an exon on both sides (two semi joins on the boundary)."""
    ends = exons.select(*group, (F.col("right") + 1).alias("left"))
    starts = exons.select(*group, (F.col("left") - 1).alias("right"))
    return junctions.join(ends, [*group, "left"], "left_semi").join(starts, [*group, "right"], "left_semi")


def unsupported_exons(exons: DataFrame, junctions: DataFrame, group: list[str]) -> DataFrame:
    """Exons that no junction touches on either side (two anti joins)."""
    before = junctions.select(*group, (F.col("right") + 1).alias("left"))
    after = junctions.select(*group, (F.col("left") - 1).alias("right"))
    return exons.join(before, [*group, "left"], "left_anti").join(after, [*group, "right"], "left_anti")
