"""Gap clustering of intervals into loci, and the split of a locus by strand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import split_score

GAP = 50
#: Positions of a block of the reference that one task works on.
BLOCK = 1_000_000


def running(df: DataFrame, group: list[str], order: list[str], value: Column, combine: str, out: str, inclusive: bool) -> DataFrame:
    """Running max or sum over a whole group, worked on block by block.

    A group such as a chromosome may hold a third of all rows, so no window spans it: each
    block has its own, and a second window over one row per block carries what came before.
    df has a column __block that never falls along ``order``.
    """
    total = (F.max if combine == "max" else F.sum)(value)
    blocks = df.groupBy(*group, "__block").agg(total.alias("__total"))
    over = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*group, "__block", (F.max if combine == "max" else F.sum)("__total").over(over).alias("__carried"))
    last = 0 if inclusive else -1
    inside = (F.max if combine == "max" else F.sum)(value).over(Window.partitionBy(*group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    joined = df.withColumn("__inside", inside).join(carried, [*group, "__block"])
    both = F.greatest("__inside", "__carried") if combine == "max" else F.coalesce("__inside", F.lit(0)) + F.coalesce("__carried", F.lit(0))
    return joined.withColumn(out, both).drop("__inside", "__carried")


def gap_cluster(df: DataFrame, group: list[str], key: str, left: str = "left", right: str = "right", gap: int = GAP, out: str = "cluster") -> DataFrame:
    """``df`` with ``out``, the number of the row's cluster in its group, from 1 in order of position.

    A row starts a cluster if its left end lies more than ``gap`` beyond every earlier right end.
    Rows are taken in order of left, right and ``key``, which makes the order a total one.
    """
    order = [left, right, key]
    rows = df.withColumn("__block", F.floor(F.col(left) / BLOCK))
    rows = running(rows, group, order, F.col(right), "max", "__reach", inclusive=False)
    starts = F.when(F.col("__reach").isNull() | (F.col(left) > F.col("__reach") + gap), 1).otherwise(0)
    rows = rows.withColumn("__starts", starts)
    rows = running(rows, group, order, F.col("__starts"), "sum", out, inclusive=True)
    return rows.drop("__block", "__reach", "__starts")


def before_starts(df: DataFrame, starts: DataFrame, group: list[str], key: str, left: str = "left", out: str = "after") -> DataFrame:
    """``df`` with ``out``, how many rows of ``starts`` have their left end at or before the row's."""
    marks = starts.select(*group, F.col("left").alias("__at"), F.lit(1).alias("__mark"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    rows = df.withColumn("__at", F.col(left)).withColumn("__mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("__block", F.floor(F.col("__at") / BLOCK)).withColumn("__order", -F.col("__mark"))
    counted = running(rows, group, ["__at", "__order", key], F.col("__mark"), "sum", out, inclusive=True)
    return counted.where("__mark = 0").drop("__at", "__mark", "__block", "__order")


def gap_cluster_session(df: DataFrame, group: list[str], left: str = "left", right: str = "right", gap: int = GAP) -> DataFrame:
    """Clusters as session windows whose gap is a row's length and ``gap`` more: bounds and counts.

    Sessions are first made of the rows of a block of positions, so that a long group is many tasks' work;
    the few sessions of the blocks are then merged in the same way.
    """
    seconds = (F.col(right) - F.col(left) + gap).cast("string")
    # Sessions merge where the next start is not beyond the end, so positions stand for seconds.
    session = F.session_window(F.timestamp_seconds(F.col(left)), F.concat(seconds, F.lit(" seconds")))
    within = df.groupBy(*group, F.floor(F.col(left) / BLOCK).alias("__block"), session.alias("s")).agg(F.min(left).alias("left"), F.max(right).alias("right"), F.count("*").alias("n_rows"))
    length = (F.col("right") - F.col("left") + gap).cast("string")
    again = F.session_window(F.timestamp_seconds(F.col("left")), F.concat(length, F.lit(" seconds")))
    return within.drop("s", "__block").groupBy(*group, again.alias("s")).agg(F.min("left").alias("left"), F.max("right").alias("right"), F.sum("n_rows").alias("n_rows")).drop("s")


def cluster_bounds(clustered: DataFrame, group: list[str], left: str = "left", right: str = "right", cluster: str = "cluster") -> DataFrame:
    return clustered.groupBy(*group, cluster).agg(F.min(left).alias("left"), F.max(right).alias("right"), F.count("*").alias("n_rows"))


def strand_split(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Where each group's 0/1 labels, in order, are best cut in two; at is an index from 0."""
    listed = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, label))).alias("rows"))
    return listed.select(*group, split_score(F.transform("rows", lambda r: r[label].cast("int"))).alias("at"), F.size("rows").alias("n_rows"))
