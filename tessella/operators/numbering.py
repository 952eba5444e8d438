"""Numbers without gaps in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import settled


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, from 1 in the order of columns that tell its rows apart.

    Rows are dealt by ranges of the order and numbered in each; what a range starts from is a sum over
    one number for each range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id())
    rows = settled(dealt.withColumn("__place", F.col("__place").bitwiseAND((1 << 33) - 1)))
    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    base, bases = 0, []
    for part in sorted(sizes):
        bases.append((part, base))
        base += sizes[part]
    before = F.broadcast(df.sparkSession.createDataFrame(bases or [(0, 0)], "__part int, __base long"))
    return rows.join(before, "__part").withColumn(out, F.col("__base") + F.col("__place") + 1).drop("__part", "__place", "__base")
