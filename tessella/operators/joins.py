"""Interval joins, mate pairing, collapse and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.intervals import contains, overlaps, strands_agree

BIN = 1000
MAX_SPAN = 1_000_000


def interval_join(a: DataFrame, b: DataFrame, on: list[str], predicate: str = "overlap", bin_width: int = BIN, a_ends: tuple[str, str] = ("left", "right"), b_ends: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Pairs of rows with equal ``on`` whose intervals overlap (or the first contains the second).

    Both sides are dealt to the bins that they touch and joined on group and bin, an equi join
    that Catalyst can shuffle, broadcast or split where it is skewed.  A pair is kept in the bin of
    the later left end alone, so it comes once.  Columns of ``b`` get the prefix ``b_``.
    """
    right = b.select(*(F.col(c) if c in on else F.col(c).alias(f"b_{c}") for c in b.columns))
    bins = lambda left, stop: F.explode(F.sequence(F.floor(left / bin_width), F.floor(stop / bin_width)))
    al, ar, bl, br = (F.col(c) for c in (*a_ends, f"b_{b_ends[0]}", f"b_{b_ends[1]}"))
    x = a.withColumn("__bin", bins(al, ar))
    y = right.withColumn("__bin", bins(bl, br))
    match: Column = contains(al, ar, bl, br) if predicate == "contain" else overlaps(al, ar, bl, br)
    return x.join(y, [*on, "__bin"]).where(match & (F.floor(F.greatest(al, bl) / bin_width) == F.col("__bin"))).drop("__bin")


def overlap_lengths(fragments: DataFrame, exons: DataFrame, on: list[str], of: str, span: int, out: str, bin_width: int = 100) -> DataFrame:
    """Each row of ``fragments`` with each ``of`` whose exons it touches, and ``out``, the summed length of what they share.

    A fragment lies in the bin of its left end alone, and the exons of an owner that can touch it are one row of that
    bin, so a pair is whole where it is made: pairs are neither shuffled nor grouped.  ``span`` is the length of
    the longest fragment; a longer one is an error.
    """
    long = F.col("right") - F.col("left") >= span
    x = fragments.withColumn("__bin", F.when(long, F.raise_error(F.lit(f"a fragment longer than {span}")).cast("long")).otherwise(F.floor(F.col("left") / bin_width)))
    touched = F.sequence(F.floor((F.col("left") - (span - 1)) / bin_width), F.floor(F.col("right") / bin_width))
    own = exons.select(*on, of, "left", "right", F.explode(touched).alias("__bin")).repartition(*on, "__bin").groupBy(*on, "__bin", of).agg(F.collect_list(F.struct("left", "right")).alias("__e"))
    # Most have one exon in a bin, which is compared without a function of arrays.
    y = own.select(*on, "__bin", of, F.col("__e")[0]["left"].alias("__l"), F.col("__e")[0]["right"].alias("__r"), F.when(F.size("__e") > 1, F.slice("__e", 2, F.size("__e") - 1)).alias("__more"))
    shared = lambda left, right: F.greatest(F.lit(0), F.least(F.col("right"), right) - F.greatest(F.col("left"), left) + 1)
    near = F.col("__more").isNotNull() | ((F.col("__l") <= F.col("right")) & (F.col("left") <= F.col("__r")))
    more = F.when(F.col("__more").isNotNull(), F.aggregate("__more", F.lit(0).cast("long"), lambda n, e: n + shared(e["left"], e["right"]))).otherwise(F.lit(0).cast("long"))
    pairs = y.join(x, [*on, "__bin"]).where(near).withColumn(out, shared(F.col("__l"), F.col("__r")) + more)
    return pairs.where(F.col(out) > 0).select(*fragments.columns, of, out)


def interval_left_join(a: DataFrame, b: DataFrame, on: list[str], key: str, **how) -> DataFrame:
    """As ``interval_join``, with the rows of ``a`` that match nothing; ``key`` is unique in ``a``."""
    pairs = interval_join(a, b, on, **how)
    return a.join(pairs.select(key, *(c for c in pairs.columns if c not in a.columns)), key, "left")


def mate_pairs(reads: DataFrame, on: list[str], position: str = "left", mate: str = "mate_left", strand: str = "strand", key: str = "id") -> DataFrame:
    """Pairs of reads of a name whose positions cross, the earlier one first.

    Strands must agree.  A read takes part in one pair: of several partners it takes the first, in
    order of ``key``, that takes it too.  Mates at one position are no pair.
    """
    left = reads.where(F.col(position) < F.col(mate))
    right = reads.where(F.col(position) > F.col(mate)).select(*on, *(F.col(c).alias(f"mate_{c}") for c in (key, strand)), F.col(position).alias("__at"), F.col(mate).alias("__back"))
    pairs = left.join(right, [*on]).where((F.col(mate) == F.col("__at")) & (F.col("__back") == F.col(position)) & strands_agree(F.col(strand), F.col(f"mate_{strand}")) & (F.col("__at") - F.col(position) <= MAX_SPAN))
    first = F.row_number().over(Window.partitionBy(key).orderBy(f"mate_{key}"))
    back = F.row_number().over(Window.partitionBy(f"mate_{key}").orderBy(key))
    return pairs.withColumn("__a", first).withColumn("__b", back).where("__a = 1 and __b = 1").drop("__a", "__b", "__at", "__back")


def collapse(df: DataFrame, signature: list[str], mass: str = "mass") -> DataFrame:
    """Equal fragments become one, with their number and summed mass."""
    return df.groupBy(*signature).agg(F.count("*").alias("n_reads"), F.sum(mass).alias("mass"))


def first_locus(reads: DataFrame, loci: DataFrame, on: list[str], key: str = "id", locus: str = "locus", bin_width: int = BIN) -> DataFrame:
    """Each read with the first locus, by left end, that it overlaps on an agreeing strand."""
    pairs = interval_join(reads, loci, on, bin_width=bin_width).where(strands_agree(F.col("strand"), F.col("b_strand")))
    return pairs.groupBy(key).agg(F.min(F.struct("b_left", f"b_{locus}"))[f"b_{locus}"].alias(locus))


def compatible(read: Column, transcript: Column) -> Column:
    """Whether a read's features follow a transcript's (arrays of struct<code,left,right>).

    Its first block lies inside an exon; each of its introns is the one that follows the exon at
    hand; each later block lies inside that exon or a later one.  Gaps (code G) may skip exons.
    """
    exons = F.filter(transcript, lambda f: f["code"] == "S")
    inside = lambda f, at: F.array_min(F.filter(F.transform(exons, lambda e, i: F.when((i >= at) & (e["left"] <= f["left"]) & (f["right"] <= e["right"]), i)), lambda i: i.isNotNull()))

    def step(at: Column, f: Column) -> Column:
        after = (F.get(exons, at)["right"] + 1 == f["left"]) & (F.get(exons, at + 1)["left"] - 1 == f["right"])
        return F.when(at == -1, at).when(f["code"] == "G", at).when(f["code"] == "I", F.when(after, at + 1).otherwise(-1)).otherwise(F.coalesce(inside(f, at), F.lit(-1)))

    return F.aggregate(read, F.lit(0), step) >= 0
