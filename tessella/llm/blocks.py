"""Batching shared by the operators that run Python: bounded Arrow batches, bounded blocks of text.

The operators are scalar-iterator pandas UDFs over the text column alone.  Spark keeps all
other columns in the JVM and zips them back by position, so extra columns, clashing names,
repeated rows and null keys need no care, and a retried task gives the same rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a block holds before its distinct words are worked on together.
BLOCK_CHARS = 24_000_000
#: The same for operators that gain little from large blocks, or whose results are as long as the texts.
SMALL_BLOCK = 4_000_000
#: Bounds of one Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: workers stay between tasks, and their idle memory adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def block_udf(make: Callable[[], object], schema: str, block_chars: int = BLOCK_CHARS) -> Callable[[Column], Column]:
    """A pandas UDF text -> struct(schema).

    ``make()`` runs once in each task and gives an object with ``add(text)``, called on every
    text (null: empty string), and ``flush() -> DataFrame``, one row for each text added since
    the last flush.  A block is flushed when it holds ``block_chars`` characters.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work, chars = make(), 0
        for texts in batches:
            for text in texts:
                text = text or ""
                work.add(text)
                chars += len(text) + 50
                if chars >= block_chars:
                    yield work.flush()
                    chars = 0
        if chars:
            yield work.flush()
        del work
        release()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)
