"""The fragment context table: fragments by the path of segments that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import sequences

#: Windows and cutoffs of the GC columns.
STRETCHES = {"gc_stretch_0.8_20": (20, 0.8), "gc_stretch_0.9_20": (20, 0.9), "gc_stretch_0.8_40": (40, 0.8), "gc_stretch_0.9_40": (40, 0.9)}


def paths(touched: DataFrame) -> DataFrame:
    """gene_id, path_symbol, path_count, gene_frag_count from rows (gene_id, fragment, left, right)."""
    order = F.array_sort(F.collect_set(F.struct("left", "right")))
    symbol = F.array_join(F.transform("segments", lambda s: F.concat(F.lit("["), s["left"].cast("string"), F.lit("-"), s["right"].cast("string"), F.lit("]"))), "")
    own = touched.groupBy("gene_id", "fragment").agg(order.alias("segments"))
    counts = own.groupBy("gene_id", symbol.alias("path_symbol")).agg(F.count("*").alias("path_count"))
    return counts.withColumn("gene_frag_count", F.sum("path_count").over(Window.partitionBy("gene_id")))


def with_sequence(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The six columns that describe a path's sequence."""
    own = F.col(seq)
    out = rows.withColumn("path_gc_content", sequences.gc_ratio(own)).withColumn("path_hexmer_entropy", sequences.kmer_entropy(own, 6))
    for name, (window, cutoff) in STRETCHES.items():
        out = out.withColumn(name, sequences.gc_stretch(own, window, cutoff).cast("int"))
    return out.drop(seq)


def with_genome(rows: DataFrame, genome: DataFrame) -> DataFrame:
    """Rows (with ref and touched, the path's segments) with the sequence columns; genome: name, seq.

    Sequences are joined by name, each read once for its rows; only the path's own part goes on.
    """
    cut = sequences.spliced_sequence(F.col("__seq"), F.col("touched"))
    named = genome.select(F.col("name").alias("ref"), F.col("seq").alias("__seq"))
    return with_sequence(rows.join(named, "ref", "left").withColumn("seq", cut).drop("__seq", "ref", "touched"))


def write(rows: DataFrame, path: str) -> None:
    """Tab-separated, with a header; an existing path is an error."""
    rows.write.mode("errorifexists").option("sep", "\t").option("header", "true").csv(path)
