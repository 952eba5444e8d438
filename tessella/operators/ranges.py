"""Range algebra within groups: merge, reduce, disjoin, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduce_ranges(df: DataFrame, group: list[str], left: str = "left", right: str = "right", touch: int = 0) -> DataFrame:
    """The union of overlapping ranges; with ``touch=1`` adjacent ones are joined too."""
    order = Window.partitionBy(*group).orderBy(left, right)
    reach = F.max(right).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(reach.isNull() | (F.col(left) > reach + touch), 1).otherwise(0)
    rows = df.withColumn("__start", start).withColumn("__island", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*group, "__island").agg(F.min(left).alias("left"), F.max(right).alias("right"), F.count("*").alias("n_ranges")).drop("__island")


def merge_adjacent(df: DataFrame, group: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """Ranges that touch (right + 1 = next left) or overlap become one."""
    return reduce_ranges(df, group, left, right, touch=1)


def coverage(df: DataFrame, group: list[str], left: str = "left", right: str = "right", weight: str | None = None) -> DataFrame:
    """Runs of constant depth above zero: left, right, depth.

    Every range is two events, summed by position before the running sum, so a window holds the
    distinct positions of a group and not its ranges.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    events = df.select(*group, F.explode(F.array(F.struct(F.col(left).alias("at"), w.alias("d")), F.struct((F.col(right) + 1).alias("at"), (-w).alias("d")))).alias("e"))
    changes = events.groupBy(*group, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    order = Window.partitionBy(*group).orderBy("at")
    runs = changes.select(*group, F.col("at").alias("left"), (F.lead("at").over(order) - 1).alias("right"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return runs.where("depth > 0 and right is not null")


def disjoin(df: DataFrame, group: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """The pieces between neighbouring boundaries that some range covers, with their depth."""
    events = df.select(*group, F.explode(F.array(F.struct(F.col(left).alias("at"), F.lit(1).alias("d")), F.struct((F.col(right) + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    changes = events.groupBy(*group, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*group).orderBy("at")
    pieces = changes.select(*group, F.col("at").alias("left"), (F.lead("at").over(order) - 1).alias("right"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return pieces.where("depth > 0 and right is not null")


def bounds(df: DataFrame, group: list[str], left: str = "left", right: str = "right") -> DataFrame:
    return df.groupBy(*group).agg(F.min(left).alias("left"), F.max(right).alias("right"))


def introns(df: DataFrame, group: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """Gaps of at least one position between neighbouring exons of a group."""
    order = Window.partitionBy(*group).orderBy(left, right)
    nexts = df.select(*group, (F.col(right) + 1).alias("left"), (F.lead(left).over(order) - 1).alias("right"))
    return nexts.where("right >= left")
