"""Interval-shaped views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reads: an event type is a reference, its second a position, its value a length."""
    e = table(spark, sf_dir, "events")
    left = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") + 1
    length = F.greatest(F.lit(1), F.col("value").cast("long"))
    return e.select(
        F.col("event_type").alias("ref"),
        F.col("event_id").alias("id"),
        F.col("user_id").alias("name"),
        left.alias("left"),
        (left + length - 1).alias("right"),
        length.alias("len"),
        F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("?")), (F.col("user_id") % 3 + 1).cast("int")).alias("strand"),
        (F.col("user_id") % 3 + 1).alias("nh"),
    )


READS = """
reads AS (SELECT event_type AS ref, event_id AS id, user_id AS name, pos AS "left", pos + len - 1 AS "right", len, ['+', '-', '?'][user_id % 3 + 1] AS strand, user_id % 3 + 1 AS nh
FROM (SELECT *, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) + 1 AS pos, greatest(1, trunc(value)::BIGINT) AS len FROM events))"""


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as exons of transcripts (orders), which lie in loci."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").cast("long").alias("q"))
    left = F.col("l_linenumber").cast("long") * 1000 + F.col("p") % 500
    return one.select((F.col("l_orderkey") % 500).alias("locus"), F.col("l_orderkey").alias("transcript"), left.alias("left"), (left + F.col("q") - 1).alias("right"))


EXONS = """
exons AS (SELECT l_orderkey % 500 AS locus, l_orderkey AS transcript, pos AS "left", pos + q - 1 AS "right"
FROM (SELECT l_orderkey, l_linenumber::BIGINT * 1000 + min(l_partkey) % 500 AS pos, trunc(max(l_quantity))::BIGINT AS q FROM lineitem GROUP BY l_orderkey, l_linenumber))"""


def rough_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as exons on a coarse grid, so that transcripts of a locus share exons, junctions and ends."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").cast("long").alias("q"))
    left = F.col("l_linenumber").cast("long") * 300 + F.col("p") % 4 * 25 + F.when(F.col("p") % 29 == 0, 7).otherwise(0)
    right = left + 59 + F.floor(F.col("q") / 15) * 35
    return one.select((F.col("l_orderkey") % 60).alias("locus"), F.col("l_orderkey").alias("transcript"), left.alias("left"), right.alias("right"))


ROUGH = """
exons AS (SELECT l_orderkey % 60 AS locus, l_orderkey AS transcript, pos AS "left", pos + 59 + q // 15 * 35 AS "right"
FROM (SELECT l_orderkey, l_linenumber::BIGINT * 300 + min(l_partkey) % 4 * 25 + CASE WHEN min(l_partkey) % 29 = 0 THEN 7 ELSE 0 END AS pos, trunc(max(l_quantity))::BIGINT AS q FROM lineitem GROUP BY l_orderkey, l_linenumber))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reads of one block, each inside a locus: equal ones are one fragment of n reads."""
    line = table(spark, sf_dir, "lineitem")
    left = F.col("l_linenumber").cast("long") * 1000 + F.col("l_suppkey") % 500
    return line.groupBy((F.col("l_orderkey") % 500).alias("locus"), left.alias("left"), (left + 4).alias("right")).agg(F.count("*").alias("n"))


BLOCKS = """, b AS (SELECT l_orderkey % 500 AS locus, l_linenumber::BIGINT * 1000 + l_suppkey % 500 AS "left", l_linenumber::BIGINT * 1000 + l_suppkey % 500 + 4 AS "right", count(*) AS n FROM lineitem GROUP BY ALL)
"""


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as mates: a turn of an even number has the one after it for its mate."""
    c = table(spark, sf_dir, "conversations")
    left, right = (F.col("turn") + 1).cast("long"), F.col("turn") + F.when(F.col("turn") % 2 == 0, 2).otherwise(0)
    return c.select(F.col("conv_id").alias("name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), left.alias("left"), right.cast("long").alias("mate_left"), F.when(F.length("text") % 3 == 0, "?").otherwise("+").alias("strand"))


MATES = """
mates AS (SELECT conv_id AS name, conv_id * 1000 + turn AS id, turn + 1 AS "left", turn + CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS mate_left, CASE WHEN length(text) % 3 = 0 THEN '?' ELSE '+' END AS strand
FROM conversations)"""
