"""FASTA sequences and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.cluster import running
from tessella.session import settled

INDEX = "name string, length long, offset long, line_bases int, line_bytes int"


def read(spark: SparkSession, path: str) -> DataFrame:
    """name and seq of each record of a file or a folder of files; line ends of any kind go."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "\r\n|\r", "\n")
    head = F.substring_index(body, "\n", 1)
    return records.select(F.regexp_extract(head, "^\\S+", 0).alias("name"), F.regexp_replace(F.substr(body, F.length(head) + 1), "\\s", "").alias("seq"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).option("sep", "\t").csv(path)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of files with one line length in each record and line feeds; offsets are in bytes.

    A line's offset is the size of all lines before it: summed within each block of a file that a task
    reads, and carried from block to block, so no task sees a whole file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("at"), (F.octet_length("value") + 1).cast("long").alias("size"),
        F.when(F.col("value").startswith(">"), F.regexp_extract("value", "^>(\\S*)", 1)).alias("name"),
    )
    rows = running(settled(lines), ["file"], ["at"], F.col("size"), "sum", "offset", inclusive=False)
    rows = running(rows, ["file"], ["at"], F.when(F.col("name").isNotNull(), 1).otherwise(0), "sum", "record", inclusive=True).drop("__block")
    bases = rows.where("name is null and record > 0").groupBy("file", "record").agg(F.sum(F.col("size") - 1).alias("length"), F.min("offset").cast("long").alias("offset"), F.min_by("size", "offset").alias("first"))
    names = rows.where("name is not null").select("file", "record", "name")
    return names.join(bases, ["file", "record"]).select("name", "length", "offset", (F.col("first") - 1).cast("int").alias("line_bases"), F.col("first").cast("int").alias("line_bytes"))


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The one record of that name."""
    return read(spark, path).where(F.col("name") == name)
