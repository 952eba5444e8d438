"""Quantification: insert sizes, bin weights, expectation-maximisation, FPKM, fraction and TPM."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import normal_pdf
from tessella.operators.whole import by_group

#: Weights up to this don't tell isoforms apart; EM stops when theta moves less than TOLERANCE.
LEAST_WEIGHT, TOLERANCE, MOST_ROUNDS = 1e-5, 1e-2, 1000


def insert_sizes(lengths: DataFrame, length: str = "len") -> DataFrame:
    """Share of each fragment length, with the mean and population deviation of all."""
    by_length = lengths.groupBy(F.col(length).alias("len")).agg(F.count("*").alias("n"))
    everything = by_length.agg(F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("len")).alias("s1"), F.sum(F.col("n") * F.col("len") * F.col("len")).alias("s2"))
    mean = F.col("s1") / F.col("n_all")
    facts = everything.select("n_all", mean.alias("mean"), F.sqrt(F.col("s2") / F.col("n_all") - mean * mean).alias("sd"))
    return by_length.join(F.broadcast(facts)).select("len", "n", (F.col("n") / F.col("n_all")).alias("p"), "mean", "sd")  # one row of facts


def insert_density(wanted: DataFrame, sizes: DataFrame, length: str = "len") -> DataFrame:
    """The density of each wanted length: its share, or the normal density where that is missing or zero."""
    facts = F.broadcast(sizes.groupBy().agg(F.first("mean").alias("mean"), F.first("sd").alias("sd")))
    own = wanted.join(sizes.select(F.col("len").alias(length), "p"), length, "left").join(facts)
    return own.withColumn("density", F.coalesce(F.nullif("p", F.lit(0.0)), normal_pdf(F.col(length), F.col("mean"), F.col("sd")))).drop("p", "mean", "sd")


def both_ends(left: Column, right: Column, between: Column, fragment: Column) -> Column:
    """Start positions of a fragment that touches two segments with ``between`` positions in between, whatever its reads hit there."""
    most = fragment - between - 1
    fits = (fragment >= between + 2) & (fragment <= left + right + between)
    return F.when(fits, F.least(left, most) + F.least(right, most) - most).otherwise(0)


def both_ends_only(left: Column, right: Column, between: Column, read: Column, gap: Column) -> Column:
    """The same where neither of its reads, with a gap between them, may hit what lies between."""
    whole = 2 * read + gap
    start = F.greatest(read, left + between - gap - 1)
    stop = F.least(left, left + right + between - gap - read)
    return F.when((whole >= between + 2) & (whole <= left + right + between), F.greatest(stop - start, F.lit(0))).otherwise(0)


def effective_lengths(segments: list[int], implicit: set[int], fragments: np.ndarray, read: int) -> np.ndarray:
    """For each fragment length, the start positions of a fragment that touches the first and the last segment,
    where its two reads hit exactly the segments that aren't ``implicit`` (indices of segments that no read hits).

    A single segment has all its positions.
    """
    n, fragments = len(segments), np.asarray(fragments)
    if n == 1:
        return np.maximum(segments[0] - fragments + 1, 0)
    inner, found = sum(segments[1:-1]), np.zeros(len(fragments), np.int64)
    edges = np.concatenate([[0], np.cumsum(segments[1:-1])])
    for start in range(1, segments[0] + 1, 4096):
        first = np.arange(start, min(segments[0] + 1, start + 4096))[:, None]  # bases in the first segment
        last = fragments[None, :] - first - inner
        ok = (last >= 1) & (last <= segments[-1])
        for k in range(1, n - 1):
            hit = (read - first > edges[k - 1]) | (read - last > inner - edges[k])
            ok &= hit == (k not in implicit)
        found += ok.sum(0)
    return found


def effective_length(segments: list[int], implicit: set[int], fragment: int, read: int) -> int:
    return int(effective_lengths(segments, implicit, np.array([fragment]), read)[0])


def bin_weight(segments: list[int], implicit: set[int], length: int, read: int, density: np.ndarray, least: int | None = None) -> float:
    """Chance of a fragment of an isoform of that length in the bin, over all fragment lengths from ``least`` (the read's).

    density: by fragment length, from 0; lengths beyond it have none.
    """
    low = max(read if least is None else least, sum(segments[1:-1]) if len(segments) > 2 else 0)
    sizes = np.arange(low, min(sum(segments), length, len(density) - 1) + 1)
    if not len(sizes):
        return 0.0
    return float((density[sizes] * effective_lengths(segments, implicit, sizes, read) / (length - sizes + 1)).sum())


def bin_weights(lengths: Column, implicit: Column, length: Column, read: int, density: np.ndarray, least: int | None = None) -> Column:
    """``bin_weight`` of columns: segment lengths, implicit indices and isoform length."""

    @F.pandas_udf("double")
    def run(segments: pd.Series, hidden: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([bin_weight(list(map(int, s)), set(map(int, h)), int(n), read, density, least) for s, h, n in zip(segments, hidden, whole)], dtype=float)

    return run(lengths, implicit, length)


def under_isoform(isoform: Column, touched: Column) -> Column:
    """struct(lengths, implicit): the isoform's segments from the first touched one to the last, and which aren't touched.

    Both are arrays of struct<left,right>, in order.
    """
    inside = F.filter(isoform, lambda s: (s["left"] >= touched[0]["left"]) & (s["left"] <= F.element_at(touched, -1)["left"]))
    hidden = F.filter(F.transform(inside, lambda s, i: F.when(~F.array_contains(touched, s), i)), lambda i: i.isNotNull())
    return F.struct(F.transform(inside, lambda s: s["right"] - s["left"] + 1).alias("lengths"), hidden.alias("implicit"))


def density_of(sizes: DataFrame, most: int | None = None) -> np.ndarray:
    """The density of every fragment length from 0 on, from ``insert_sizes`` (a row for each length, at most 1,000,000)."""
    rows = sizes.select("len", "p", "mean", "sd").toPandas()
    if not len(rows):
        return np.zeros(1)
    mean, sd = float(rows["mean"].iat[0]), float(rows["sd"].iat[0])
    out = normal_density(mean, sd, most or int(max(rows["len"].max(), mean + 6 * sd)))
    seen = rows[(rows["len"] < len(out)) & (rows["p"] > 0)]
    out[seen["len"].to_numpy(int)] = seen["p"].to_numpy(float)
    return out


def normal_density(mean: float, sd: float, most: int) -> np.ndarray:
    x = np.arange(most + 1)
    return np.exp(-(((x - mean) / sd) ** 2) / 2) / (sd * np.sqrt(2 * np.pi)) if sd > 0 else (x == round(mean)).astype(float)


def em(counts: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
    """Reads of each isoform of one locus, from reads by bin and weights by bin and isoform.  None if no bin tells anything."""
    bin_of, isoform_of = np.nonzero(weights)
    n, m = weights.shape
    theta, told = em_many(np.asarray(counts, float), bin_of, isoform_of, weights[bin_of, isoform_of].astype(float), np.zeros(n, int), np.zeros(m, int))
    return theta if told[0] else None


def em_many(counts: np.ndarray, bin_of: np.ndarray, isoform_of: np.ndarray, weights: np.ndarray, bin_locus: np.ndarray, isoform_locus: np.ndarray, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Reads of each isoform of many loci at once, and whether a locus had anything to go by.

    Weights are given in sparse form (bin_of, isoform_of, weights), bins and isoforms by their loci.  Weights
    are scaled anew by column in every round, and the round before the one that moves a locus less than
    ``TOLERANCE`` is returned for it.  Loci without a telling bin share their reads evenly.  copies: how many
    isoforms of the same bins and weights each one stands for; theta is that of one of them.
    """
    copies = np.ones(len(isoform_locus)) if copies is None else copies.astype(float)
    counts = np.floor(counts)
    loci = int(max(bin_locus.max(initial=-1), isoform_locus.max(initial=-1))) + 1
    per = np.maximum(np.bincount(isoform_locus, copies, loci), 1)
    theta = (np.bincount(bin_locus, counts, loci) / per)[isoform_locus]
    telling = np.zeros(len(counts), bool)
    telling[bin_of[weights > LEAST_WEIGHT]] = True
    told = np.bincount(bin_locus, telling, loci) > 0
    own = telling[bin_of]
    b, i, f = bin_of[own], isoform_of[own], weights[own].astype(float)
    active = told.copy()
    for _ in range(MOST_ROUNDS):
        live = active[isoform_locus[i]]
        if not live.any():
            break
        if not live.all():
            b, i, f = b[live], i[live], f[live]
        share = f * theta[i]
        total = np.bincount(b, share * copies[i], len(counts))
        empty = telling & active[bin_locus] & (total == 0)
        if empty.any():
            lost = np.zeros(loci, bool)
            lost[bin_locus[empty]] = True
            told &= ~lost
            active &= ~lost
        new = np.bincount(i, counts[b] * np.divide(share, total[b], out=np.zeros_like(share), where=total[b] > 0), len(theta))
        column = np.bincount(i, f, len(theta))
        f = np.divide(f, column[i], out=np.zeros_like(f), where=column[i] > 0)
        moving = active[isoform_locus]
        moved = np.sqrt(np.bincount(isoform_locus, copies * np.where(moving, new - theta, 0.0) ** 2, loci))
        active &= moved >= TOLERANCE
        theta = np.where(active[isoform_locus], new, theta)
    return theta, told


def em_abundance(bins: DataFrame) -> DataFrame:
    """theta by locus and isoform.  bins: locus, bin, n, isoform, weight (long form, any order).

    A task works on the whole loci of a batch at once.  A locus where EM has nothing to go by shares its reads evenly.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby(["locus", "bin", "isoform"], as_index=False, sort=False).agg(n=("n", "first"), weight=("weight", "sum"))
        locus, names = pd.factorize(rows["locus"])
        bin_of, bins_ = pd.MultiIndex.from_arrays([locus, rows["bin"]]).factorize()
        isoform_of, isoforms = pd.MultiIndex.from_arrays([locus, rows["isoform"]]).factorize()
        counts = np.zeros(len(bins_))
        counts[bin_of] = rows["n"].to_numpy(float)
        of = lambda index: index.get_level_values(0).to_numpy(int)
        theta, _ = em_many(counts, bin_of, isoform_of, rows["weight"].to_numpy(float), of(bins_), of(isoforms))
        return pd.DataFrame({"locus": np.asarray(names)[of(isoforms)], "isoform": isoforms.get_level_values(1).astype("int64"), "theta": theta})

    dealt = bins.select(F.col("locus").cast("long").alias("locus"), "bin", "n", "isoform", "weight").repartition("locus").sortWithinPartitions("locus")
    return dealt.mapInPandas(by_group(["locus"], work), "locus long, isoform long, theta double")


class Ranges:
    """Sums of numbers over ranges of them, and at each number the sum of what its ranges bring.

    A range is cut once, where its ends part in the binary tree over the numbers.  What is left of the cut ends a block
    of the least power of two, and what is right of it starts one, so running sums inside such blocks are all it takes.
    Nothing is ever subtracted: sums are as good as added one by one, and those of zeros are zero.  Ranges are taken in
    ``order``: those that are cut first.
    """

    def __init__(self, low: np.ndarray, last: np.ndarray, size: int):
        bits = lambda x: np.frexp(x.astype(float))[1].astype(int)
        self.order = np.argsort(low == last, kind="stable")
        self.n, self.cut, self.size = len(low), int(np.count_nonzero(low != last)), size
        low, last = low[self.order], last[self.order][: self.cut]
        right = bits(low[: self.cut] ^ last) - 1
        right = last >> right << right
        block = bits(np.maximum(right - low[: self.cut], last - right + 1) - 1)
        # A row of running sums for each size of blocks and direction: even ones backwards.
        kind = np.concatenate([2 * block, np.zeros(self.n - self.cut, int), np.where(block, 2 * block + 1, 0)])
        self.rows, row = np.unique(kind, return_inverse=True)
        top = int(block.max(initial=0))
        self.width = -(-size >> top) << top
        self.node = row * self.width + np.concatenate([low, last])

    def _running(self, table: np.ndarray, turned: int) -> None:
        for kind, row in zip(self.rows.tolist(), table):
            if kind:
                blocks = row.reshape(-1, 1 << kind // 2)
                blocks = blocks if (kind + turned) % 2 else blocks[:, ::-1]
                np.cumsum(blocks, axis=1, out=blocks)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of the values of each range."""
        table = np.zeros((len(self.rows), self.width))
        table[:, : self.size] = values
        self._running(table, 0)
        parts = table.ravel().take(self.node)
        parts[: self.cut] += parts[self.n :]
        return parts[: self.n]

    def spread(self, brings: np.ndarray) -> np.ndarray:
        """At each number the sum of what the ranges around it bring."""
        table = np.bincount(self.node, np.concatenate([brings, brings[: self.cut]]), len(self.rows) * self.width).reshape(-1, self.width)
        self._running(table, 1)
        return table.sum(0)[: self.size]


def em_ranges(counts: np.ndarray, low: np.ndarray, last: np.ndarray, isoform_of: np.ndarray, weights: np.ndarray, bin_locus: np.ndarray, isoform_locus: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """theta of ``em_many`` where the bins of an isoform are ranges (low to last), each bin in one at most, and all have its weight.

    Weights scaled by column are then 1 / bins of the isoform after the first round, and a round takes as long as
    there are ranges, not pairs of bin and isoform.
    """
    counts, copies = np.floor(counts), copies.astype(float)
    loci, m = int(max(bin_locus.max(initial=-1), isoform_locus.max(initial=-1))) + 1, len(isoform_locus)
    theta = (np.bincount(bin_locus, counts, loci) / np.maximum(np.bincount(isoform_locus, copies, loci), 1))[isoform_locus]
    bins, ranges = np.arange(len(counts)), Ranges(low, last, len(counts))
    of = isoform_of[ranges.order]
    telling = ranges.spread((weights > LEAST_WEIGHT)[of].astype(float)) > 0
    size = np.bincount(of, ranges.sums(telling.astype(float)), m)
    scaled = np.divide(1.0, size, out=np.zeros(m), where=size > 0)
    active = np.bincount(bin_locus, telling, loci) > 0
    held, f = loci, weights
    for _ in range(MOST_ROUNDS):
        if not active.any():
            break
        if 2 * active.sum() <= held:
            held, bins, own = active.sum(), np.flatnonzero(active[bin_locus]), active[isoform_locus[isoform_of]]
            ranges = Ranges(np.searchsorted(bins, low[own]), np.searchsorted(bins, last[own]), len(bins))
            of = isoform_of[own][ranges.order]
        share = f * theta
        total = ranges.spread((share * copies)[of])
        known = telling[bins]
        empty = known & (total == 0)
        if empty.any():
            active[bin_locus[bins[empty]]] = False
        rate = np.divide(counts[bins], total, out=np.zeros(len(bins)), where=known & ~empty)
        new = share * np.bincount(of, ranges.sums(rate), m)
        f = scaled
        moved = np.sqrt(np.bincount(isoform_locus, copies * (new - theta) ** 2, loci))
        active &= moved >= TOLERANCE
        theta = np.where(active[isoform_locus], new, theta)
    return theta


def em_contained(exons: DataFrame, fragments: DataFrame) -> DataFrame:
    """theta by locus and isoform, of the isoforms with an exon that holds a fragment; weights are 1/length.

    exons: locus, isoform, left, right; fragments: locus, left, right, n.  Fragments that the same isoforms
    hold are one bin.  Exons and fragments are dealt by locus and meet inside the task, so neither their pairs
    nor the sets of isoforms are ever rows; nor are pairs made there, as an exon holds ranges of sorted fragments.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        found = [x for g, own in rows.groupby("locus", sort=False) if (x := contained_bins(own)) is not None]
        if not found:
            return pd.DataFrame({"locus": [], "isoform": [], "theta": []}).astype({"locus": "int64", "isoform": "int64"})
        locus = [own["locus"] for own in found]
        n_bins, n_isoforms = ([len(own[c]) for own in found] for c in ("counts", "copies"))
        start = lambda n: np.cumsum([0, *n[:-1]])
        all_of = lambda c, n=None: np.concatenate([own[c] if n is None else own[c] + at for own, at in zip(found, start(n or n_bins))])
        each = np.arange(len(found))
        theta = em_ranges(all_of("counts"), all_of("low", n_bins), all_of("last", n_bins), all_of("isoform_of", n_isoforms), all_of("weights"), np.repeat(each, n_bins), np.repeat(each, n_isoforms), all_of("copies"))
        names = [own["names"] for own in found]
        return pd.DataFrame({"locus": np.repeat(locus, [len(x) for x in names]), "isoform": np.concatenate(names), "theta": theta[all_of("kind", n_isoforms)]})

    none = F.lit(-1).cast("long")
    both = exons.select("locus", "isoform", "left", "right", none.alias("n")).unionByName(fragments.select("locus", none.alias("isoform"), "left", "right", "n"))
    # A fixed number of partitions: by their bytes they would be made one for each core, though the work is many times that of reading them.
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.dropna().select(*(F.col(c).cast("long").alias(c) for c in both.columns)).repartition(parts, "locus").sortWithinPartitions("locus")
    return dealt.mapInPandas(by_group(["locus"], work), "locus long, isoform long, theta double")


def chains(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of intervals in chains, inside which neither end falls, as few as can be; and where each starts, with the end of all.

    What an interval holds of a chain is one range of it.
    """
    order = np.lexsort((right, left))
    ends = right[order]
    if (np.diff(ends) >= 0).all():
        return order, np.array([0, len(order)])
    tops: list[int] = []
    chain = np.empty(len(ends), int)
    for k, x in enumerate(ends.tolist()):
        chain[k] = at = bisect_left(tops, -x)
        tops[at : at + 1] = [-x]
    dealt = np.argsort(chain, kind="stable")
    return order[dealt], np.searchsorted(chain[dealt], np.arange(len(tops) + 1))


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (high is excluded) of the same group that meet made one; in order of group and position."""
    base = group * (int(high.max(initial=0)) + 1)
    order = np.argsort(base + low, kind="stable")
    group, low, high, base = group[order], low[order], high[order], base[order]
    starts = np.flatnonzero(np.concatenate([[True], (base + low)[1:] > np.maximum.accumulate(base + high)[:-1]]))
    return group[starts], low[starts], np.maximum.reduceat(high, starts)


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of keys, and for each row the number of its own among these."""
    order = np.lexsort(keys)
    new = np.concatenate([[True], np.logical_or.reduce([(k := key[order])[1:] != k[:-1] for key in keys])])
    of = np.empty(len(order), int)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def contained_bins(rows: pd.DataFrame) -> dict | None:
    """The bins of one locus for ``em_ranges``; isoforms of the same bins and length are one of several copies.

    rows: isoform, left, right, and n, which is -1 for an exon.  None if no exon holds a fragment.  Sets (of the
    isoforms around a fragment, of the bins of an isoform) are told apart by sums of two random 64-bit numbers for
    each member, which are equal for two different sets with a chance of 2^-128.
    """
    isoform, left, right, n = (rows[c].to_numpy() for c in ("isoform", "left", "right", "n"))
    exon = n < 0
    names, whose = np.unique(isoform[exon], return_inverse=True)
    length = np.bincount(whose, right[exon] - left[exon] + 1, len(names))
    order, cuts = chains(left[~exon], right[~exon])
    f_left, f_right, f_n = left[~exon][order], right[~exon][order], n[~exon][order]
    found = []
    for s, e in zip(cuts[:-1], cuts[1:]):
        a = s + np.searchsorted(f_left[s:e], left[exon], "left")
        b = s + np.searchsorted(f_right[s:e], right[exon], "right")
        holds = b > a
        found.append((whose[holds], a[holds], b[holds]))
    i, a, b = (np.concatenate(c) for c in zip(*found))
    if not len(i):
        return None
    i, a, b = merged(i, a, b)
    random = lambda n: np.random.default_rng(n).integers(0, 2**64 - 1, (2, n), np.uint64, True)
    # A bin for each set of isoforms, in place of its first fragment.
    mark, steps, depth = random(len(names)), np.zeros((2, len(order) + 1), np.uint64), np.bincount(a, minlength=len(order) + 1) - np.bincount(b, minlength=len(order) + 1)
    for own, step in zip(mark, steps):
        np.add.at(step, a, own[i])
        np.subtract.at(step, b, own[i])
    held = np.flatnonzero(np.cumsum(depth))
    first, of = distinct(*np.cumsum(steps, axis=1)[:, held])
    placed = np.argsort(first)
    heads, counts = held[first[placed]], np.bincount(of, f_n[held])[placed]
    low, last = np.searchsorted(heads, a), np.searchsorted(heads, b) - 1
    full = low <= last
    i, low, last = i[full], low[full], last[full]
    # One for the isoforms of the same bins and length.
    own, whose = np.unique(i, return_inverse=True)
    sums = np.zeros((2, len(own)), np.uint64)
    for mark, step in zip(random(len(heads)), sums):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mark)])
        np.add.at(step, whose, upto[last + 1] - upto[low])
    first, kind = distinct(length[own], *sums)
    shown = first[kind[whose]] == whose
    return {
        "locus": rows["locus"].iat[0],
        "names": names[own],
        "kind": kind,
        "copies": np.bincount(kind),
        "counts": counts,
        "low": low[shown],
        "last": last[shown],
        "isoform_of": kind[whose[shown]],
        "weights": 1.0 / length[own[first]],
    }


def normalise(df: DataFrame, locus: str, theta: str, length: str, least_fraction: float = 0.0, mapped: DataFrame | None = None) -> DataFrame:
    """fpkm, frac (of the locus) and tpm; isoforms below the fraction go, and others keep theirs.

    mapped: one row with one column, the reads of everything; else the sum of ``theta``.  Totals over
    everything are one row, broadcast; a window over all rows would be one task.
    """
    total = F.broadcast(df.agg(F.sum(theta).alias("__all")) if mapped is None else mapped.toDF("__all"))
    fpkm = df.join(total).withColumn("fpkm", F.col(theta) * 1e6 / F.col("__all") * 1e3 / F.col(length)).drop("__all")
    frac = fpkm.withColumn("frac", F.col("fpkm") / F.sum("fpkm").over(Window.partitionBy(locus))).where(F.col("frac") >= least_fraction)
    sums = F.broadcast(frac.agg(F.sum("fpkm").alias("__all")))
    return frac.join(sums).withColumn("tpm", F.col("fpkm") * 1e6 / F.col("__all")).drop("__all")
