"""Connected components of a graph given by edges, by alternating star operations.

Each round is a few aggregations and joins on the node, checkpointed to the shared folder; the
number of rounds grows with the logarithm of the longest path.  Nothing is collected but counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a written result that one task reads at least, where there are so many tasks.
TASK_ROWS = 10_000


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: written where all executors read it, so a lost one costs nothing.

    The folder is the session's spark.checkpoint.dir; only where that is unset, as in tests, one
    in the warehouse is used.  A result of few rows is read by few tasks, however many wrote it: a
    shuffle writes files for each of its tasks, and the rounds of a loop have many shuffles.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    done = df.checkpoint()
    tasks = done._jdf.rdd().getNumPartitions()
    wanted = -(-done.count() // TASK_ROWS) if tasks > 1 else tasks
    return done.coalesce(max(1, wanted)) if wanted < tasks else done


#: A graph of so many edges at most (16 bytes each) is solved by one task, a larger one by rounds.
SMALL = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b long) the smallest node of its component.

    Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    facts = _facts(now)
    if facts[0] <= SMALL:
        return now.coalesce(1).mapInPandas(_solved, "node long, root long")
    return _by_rounds(now)


def _facts(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            u, v = root(a), root(b)
            parent[max(u, v)] = min(u, v)
    yield pd.DataFrame({"node": list(parent), "root": [root(x) for x in parent]}, dtype="int64")


def _by_rounds(now: DataFrame) -> DataFrame:
    """Alternating stars over distinct edges (a > b), a few aggregations and joins a round."""
    before, facts = None, _facts(now)
    while facts != before:
        before = facts
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = durable(small.where("a <> b").distinct())
        facts = _facts(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
