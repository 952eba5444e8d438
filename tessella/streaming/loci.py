"""Streaming forms: loci as session windows over event time, mates as a stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def locus_sessions(events: DataFrame, group: list[str], time: str = "ts", length: str = "len", gap: int = 50, late: str = "10 minutes") -> DataFrame:
    """Clusters of events whose sessions last for their length and ``gap`` seconds more.

    With a watermark a locus closes once no event can reach it; later ones are dropped, as an
    out-of-order read is.
    """
    seconds = F.concat((F.col(length) - 1 + gap).cast("string"), F.lit(" seconds"))
    session = F.session_window(F.col(time), seconds)
    return events.withWatermark(time, late).groupBy(*group, session.alias("s")).agg(F.count("*").alias("n_rows")).select(*group, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n_rows")


def mate_stream(left: DataFrame, right: DataFrame, name: str, time: str = "ts", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pairs of two streams of mates by name, where the second comes within a time of the first."""
    a = left.withWatermark(time, late).select(F.col(name).alias("name"), F.col(time).alias("first_ts"), F.col("id").alias("first_id"))
    b = right.withWatermark(time, late).select(F.col(name).alias("name2"), F.col(time).alias("second_ts"), F.col("id").alias("second_id"))
    close = F.expr(f"name = name2 and second_ts >= first_ts and second_ts <= first_ts + interval {within}")
    return a.join(b, close).drop("name2")
