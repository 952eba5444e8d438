"""Bounded samples of distinct texts that don't depend on how the rows are dealt.

A sample of a kind is its first so many distinct texts in order of hash.  However many copies of a
text there are, it counts once, so copies cannot crowd others out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many times the wanted number a first look takes by hash, and by how much a further one is wider.
FIRST, WIDER = 4, 16


def text_hash(text: Column) -> Column:
    """A text's hash from 0 up."""
    return F.shiftrightunsigned(F.xxhash64(text, F.octet_length(text)), 1)


def below(h: Column, share: Column) -> Column:
    return h < share * F.lit(float(1 << 63))


def first_of_each(rows: DataFrame, counts: dict, want: dict) -> DataFrame:
    """kind, h: the first ``want[kind]`` distinct hashes of each kind in ``counts`` (rows by kind).

    rows: kind, h.  Only hashes below a share are looked at, which grows where they are too few, so
    the result is the same whatever the share; it has at most the sum of ``want`` rows, on the driver.
    """
    spark, kind = rows.sparkSession, rows.schema["kind"].dataType.simpleString()
    todo = {k: min(1.0, FIRST * want[k] / max(1, n)) for k, n in counts.items()}
    chosen = []
    while todo:
        shares = F.broadcast(spark.createDataFrame([(k, s, want[k]) for k, s in todo.items()], f"kind {kind}, share double, want int"))
        near = rows.join(shares, "kind").where(below(F.col("h"), F.col("share"))).select("kind", "h", "want").distinct()
        place = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
        found = near.withColumn("n", place).where("n <= want").select("kind", "h").collect()
        had = {k: [r["h"] for r in found if r["kind"] == k] for k in todo}
        chosen += [(k, h) for k, own in had.items() if len(own) == want[k] or todo[k] == 1.0 for h in own]
        todo = {k: min(1.0, s * WIDER) for k, s in todo.items() if len(had[k]) < want[k] and s < 1.0}
    return spark.createDataFrame(chosen, f"kind {kind}, h long")


def one_of_each(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row of ``rows`` (kind, h and others) for each chosen (kind, h); chosen is bounded by its maker."""
    return rows.join(F.broadcast(chosen), ["kind", "h"]).dropDuplicates(["kind", "h"])
