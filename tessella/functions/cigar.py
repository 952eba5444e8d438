"""Alignment records: CIGAR arrays (struct<op,len>), flags, strands, features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_INTRON, MAX_INTRON = 20, 300_000
#: Flag bits of alignment records.
PAIRED, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100


def parse(text: Column) -> Column:
    """A CIGAR string as array<struct<op:string,len:int>>; ``*`` and empty give an empty array."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, "^[0-9]+", 0).cast("int").alias("len")))


def total(cigar: Column, ops: str) -> Column:
    """Summed lengths of the given operations."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["len"])


def reference_span(cigar: Column) -> Column:
    return total(cigar, "MDN")


def read_length(cigar: Column) -> Column:
    return total(cigar, "MIS")


def spliced(cigar: Column) -> Column:
    return F.exists(cigar, lambda x: x["op"] == "N")


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def valid_cigar(cigar: Column, min_intron: int = MIN_INTRON, max_intron: int = MAX_INTRON) -> Column:
    """Whether a record's CIGAR is kept.

    No empty operation, no operation beyond M I D N S H P, introns within bounds, an insertion or
    deletion only from the third operation on and not last, and more than one aligned base.
    """
    n = F.size(cigar)
    sound = F.forall(cigar, lambda x: (x["len"] > 0) & x["op"].isin(*"MIDNSHP"))
    introns = F.forall(cigar, lambda x: (x["op"] != "N") | x["len"].between(min_intron, max_intron))
    places = F.transform(cigar, lambda x, i: ~x["op"].isin("I", "D") | ((i >= 2) & (i < n - 1)))
    flanked = F.transform(cigar, lambda x, i: ~x["op"].isin("I", "D") | ((F.get(cigar, i - 1)["op"] == "M") & (F.get(cigar, i + 1)["op"] == "M")))
    return sound & introns & F.forall(places, lambda x: x) & F.forall(flanked, lambda x: F.coalesce(x, F.lit(False))) & (total(cigar, "M") > 1)


def mapped(flag: Column, ref: Column) -> Column:
    return ~has(flag, UNMAPPED) & ref.isNotNull()


def unique_hit(flag: Column, nh: Column, allow_multimapped: bool = False) -> Column:
    return F.lit(True) if allow_multimapped else (F.coalesce(nh, F.lit(1)) <= 1) & ~has(flag, SECONDARY)


def mass(singleton: Column, nh: Column) -> Column:
    """1 for a single read, half for a mate, shared over its places."""
    return F.when(singleton, 1.0).otherwise(0.5) / F.coalesce(nh, F.lit(1))


def strand(xs: Column, flag: Column, library: str | None = None) -> Column:
    """The strand tag, else what the library type (fr, rf or None) says of the flags, else ``?``.

    A record that isn't the first of its pair, single ones included, counts as second.
    """
    guess = F.lit("?")
    if library in ("fr", "rf"):
        plus = (has(flag, FIRST) != has(flag, REVERSE)) if library == "fr" else (has(flag, FIRST) == has(flag, REVERSE))
        guess = F.when(plus, "+").otherwise("-")
    return F.coalesce(F.when(xs.isin("+", "-"), xs), guess)


def features(left: Column, cigar: Column) -> Column:
    """array<struct<code,left,right>>: M and D lengthen a block (S), N is an intron (I), else nothing."""
    start = F.struct(left.cast("long").alias("at"), F.array().cast("array<struct<code:string,left:bigint,right:bigint>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        stop = a["at"] + x["len"] - 1
        last = F.try_element_at(a["done"], F.lit(-1))
        new = lambda code: F.array(F.struct(F.lit(code).alias("code"), a["at"].alias("left"), stop.alias("right")))
        grown = F.concat(F.slice(a["done"], 1, F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(F.struct(F.lit("S").alias("code"), last["left"].alias("left"), stop.alias("right"))))
        block = F.when((F.size(a["done"]) > 0) & (last["code"] == "S"), grown).otherwise(F.concat(a["done"], new("S")))
        moved = lambda done: F.struct((stop + 1).alias("at"), done.alias("done"))
        return F.when(x["op"].isin("M", "D"), moved(block)).when(x["op"] == "N", moved(F.concat(a["done"], new("I")))).otherwise(a)

    return F.aggregate(cigar, start, step, lambda a: a["done"])


def intron_coords(left: Column, cigar: Column) -> Column:
    return F.transform(F.filter(features(left, cigar), lambda f: f["code"] == "I"), lambda f: F.struct(f["left"].alias("left"), f["right"].alias("right")))
