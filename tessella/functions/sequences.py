"""DNA sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.stats import entropy


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in upper case, letters beyond ACGT read as A, in order of the sequence."""
    clean = F.upper(F.regexp_replace(seq, "[^ACGTacgt]", "A"))
    n = F.length(clean) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(clean, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def packed_kmers(seq: Column, k: int) -> Column:
    """The k-mers (k < 32) as numbers of two bits a base, sorted."""
    digits = lambda w: F.conv(F.translate(w, "ACGT", "0123"), 4, 10).cast("long")
    return F.array_sort(F.transform(kmers(seq, k), digits))


def kmer_entropy(seq: Column, k: int) -> Column:
    """Entropy in nats of the k-mers' shares; 0 for a sequence that is too short.

    Sorted k-mers lie in runs; a run's length is the distance between neighbouring starts.
    """
    own = F.array_sort(kmers(seq, k))
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
    counts = lambda s: F.transform(F.array(starts(s)), lambda at: F.transform(at, lambda i, j: (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("double")))[0]
    return F.transform(F.array(own), lambda s: F.when(F.size(s) > 0, entropy(counts(s))).otherwise(0.0))[0]


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GCgc", ""))


def gc_ratio(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, gc_count(seq) / F.length(seq))


def gc_stretch(seq: Column, window: int, cutoff: float) -> Column:
    """Whether any window has a GC ratio above the cutoff."""
    n = F.length(seq) - window + 1
    return F.when(n > 0, F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: gc_count(F.substring(seq, i, F.lit(window))) / window > cutoff)).otherwise(False)


def fetch(seq: Column, start: Column, size: Column) -> Column:
    """``size`` bases from the 1-based ``start``."""
    return F.substring(seq, start, size)


def spliced_sequence(seq: Column, blocks: Column) -> Column:
    """The sequence under array<struct<left,right>>, joined."""
    return F.array_join(F.transform(blocks, lambda b: F.substring(seq, b["left"].cast("int"), (b["right"] - b["left"] + 1).cast("int"))), "")
