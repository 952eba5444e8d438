"""Training-order materialisation: every sequence gets a global slot, and shards have a fixed stride.

Documents are encoded, joined end to end and cut into sequences, which are numbered without gaps from
0.  A keyed Feistel network permutes the numbers; its domain is the next power of four, and a number
that falls beyond the count is sent through again (cycle-walking), so the slots are the same dense
range.  A shard holds ``SHARD`` consecutive slots as records of one size, so a reader finds any slot
with one seek and resumes where it stopped.  Shards and index are written and read by Spark's own
readers and writers, so any store that Spark reaches will do, and a retried task leaves no half shard.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.blocks import SMALL_BLOCK, bound_batches, release
from tessella.llm.bpe import _Encode, vocabulary
from tessella.llm.components import durable
from tessella.llm.exprs import col, let

#: Tokens of a sequence, sequences of a shard (16 MB), and rounds of the network.
SEQUENCE, SHARD, ROUNDS = 512, 16_384, 6
#: Packed sequences lie on disk beside the shuffle and the shards, so they are packed harder.
PACKED_LEVEL = 6
#: A record in a shard ends in a line feed, as Spark's writer ends it.
END = 1


def _round_keys(key: int) -> list[np.uint64]:
    keys, state = [], np.uint64(key & (2**64 - 1))
    with np.errstate(over="ignore"):
        for _ in range(ROUNDS):
            state += np.uint64(0x9E3779B97F4A7C15)
            keys.append(_mix(np.array([state]))[0])
    return keys


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slots of sequence numbers 0 to count - 1: a permutation of them that ``key`` picks."""
    half = np.uint64(max(1, -(-max(1, int(count - 1).bit_length()) // 2)))
    mask, keys = np.uint64((1 << int(half)) - 1), _round_keys(key)
    x = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        x[todo] = left << half | right
        todo = todo[x[todo] >= count]
    return x.astype(np.int64)


def id_bytes(path: str) -> int:
    """Bytes of an id in the shards: two where the vocabulary fits, else four."""
    return 2 if max(vocabulary(path).tokens) < 1 << 16 else 4


class _Cut:
    """Sequences of the documents added, one after the other, each document ended by the filler."""

    def __init__(self, path: str, length: int, pad: int, width: int):
        self.work, self.length, self.pad, self.kind, self.next = _Encode(path), length, pad, f"<u{width}", 0
        self.keys: list = []

    def add(self, key, text: str) -> None:
        self.work.add(text)
        self.keys.append(key)

    def flush(self) -> pd.DataFrame:
        """The sequences of a block of documents; the last one is filled up."""
        found = [(k, ids) for k, ids in zip(self.keys, self.work.encoded()) if len(ids)]
        self.keys = []
        sizes = np.array([len(ids) + 1 for _, ids in found], np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        n = -(-total // self.length)
        flat = np.full(n * self.length, self.pad, self.kind)
        for (_, ids), end in zip(found, ends.tolist()):
            flat[end - len(ids) - 1 : end - 1] = ids
        at = np.arange(n) * self.length
        first = np.searchsorted(ends, at, "right")
        last = np.searchsorted(ends, np.minimum(at + self.length, total), "left")
        out = pd.DataFrame(
            {
                "number": np.arange(self.next, self.next + n),
                "docs": [[found[k][0] for k in range(a, b + 1)] for a, b in zip(first.tolist(), last.tolist())],
                "n_tokens": np.minimum(self.length, total - at).astype(np.int32),
                "payload": [x.tobytes() for x in flat.reshape(n, self.length)],
            }
        )
        self.next += n
        return out


def sequences(docs: DataFrame, path: str, pad: int, doc: str = "doc_id", text: str = "text", length: int = SEQUENCE) -> DataFrame:
    """task, number (in the task, from 0), docs (their keys, as strings), n_tokens (before filler) and payload."""
    bound_batches(docs.sparkSession)
    width = id_bytes(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, chars = _Cut(path, length, pad, width), 0
        gc.disable()  # many small lists and no cycles: looking for those takes a twentieth of the time
        try:
            for batch in batches:
                for key, own in zip(batch["key"], batch["text"]):
                    work.add(key, own or "")
                    chars += len(own or "") + 50
                    if chars >= SMALL_BLOCK:
                        yield work.flush()
                        chars = 0
            if chars:
                yield work.flush()
        finally:
            gc.enable()
        del work
        release()

    own = docs.select(col(doc).cast("string").alias("key"), col(text).alias("text"))
    cut = own.mapInPandas(run, "number long, docs array<string>, n_tokens int, payload binary")
    return cut.select(F.spark_partition_id().alias("task"), "*")


def training_order(docs: DataFrame, path: str, pad: int, key: int = 1, doc: str = "doc_id", text: str = "text", length: int = SEQUENCE, shard: int = SHARD, packed: str | None = None) -> DataFrame:
    """A row for each sequence, in no order.

    slot, shard, place (slot's place in the shard), docs (array of the keys of the documents that it has
    tokens of, in order), n_tokens and payload: ``length`` little-endian ids of two bytes (four for a
    vocabulary that needs them), filled up with ``pad``, which also ends each document.  Null and
    empty texts have no tokens; null keys are nulls in docs; repeated rows have their tokens each; an
    empty table gives no sequence; other columns aren't looked at.  Numbers follow the input's partitions
    and the rows in them, so the same files and split size give the same order: an order by key would
    have to shuffle all tokens a second time.  packed: where the sequences are kept that the rows are read from, a new
    folder that all executors share; who names it can remove it once the rows are written elsewhere.
    """
    spark, kind = docs.sparkSession, docs.select(col(doc)).schema[0].dataType.simpleString()
    rows = spark.read.parquet(stored(sequences(docs, path, pad, doc, text, length), packed, PACKED_LEVEL))
    sizes = {r["task"]: r["n"] for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()}  # one number for each task of the scan
    bases, count = {}, 0
    for task in sorted(sizes):
        bases[task], count = count, count + sizes[task]
    before = F.broadcast(spark.createDataFrame(sorted(bases.items()) or [(0, 0)], "task int, base long"))

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(slots(numbers.to_numpy(), count, key))

    placed = rows.join(before, "task").select(slot(F.col("base") + F.col("number")).alias("slot"), F.col("docs").cast(f"array<{kind}>").alias("docs"), "n_tokens", "payload")
    return placed.select("slot", F.floor(F.col("slot") / shard).cast("int").alias("shard"), (F.col("slot") % shard).cast("int").alias("place"), "docs", "n_tokens", "payload")


def stored(df: DataFrame, folder: str | None = None, level: int = 3) -> str:
    """Write a table to a folder that all executors share, a new one if none is named; its path.  level: how hard zstd tries."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": str(level)}).parquet(folder)
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of a store that Spark reaches, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir."""
    if spark.sparkContext.getCheckpointDir() is None:
        durable(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write ``training_order``'s rows: one file of records in each folder shard=N, and the index of slots.

    Sequences are dealt by shard and sorted by slot, one shard to a task.  Returns the index: slot, shard,
    place, docs, n_tokens, in no order.  An existing folder is an error.
    """
    ordered.drop("payload").write.mode("errorifexists").parquet(f"{folder}/index")
    index = ordered.sparkSession.read.parquet(f"{folder}/index")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    dealt = ordered.select("shard", "slot", F.col("payload").cast("string").alias("value")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    dealt.select("value", "shard").write.mode("errorifexists").partitionBy("shard").text(f"{folder}/shards")
    return index


def read_shards(spark: SparkSession, folder: str, length: int = SEQUENCE, width: int = 2, shard: int = SHARD) -> DataFrame:
    """slot and payload of every record, by its place in its file."""
    size = length * width
    files = spark.read.format("binaryFile").load(f"{folder}/shards")
    places = F.sequence(F.lit(0), (F.col("length") / (size + END)).cast("int") - 1)
    # The content is named once: a column that a lambda reads would be copied whole for each record.
    record = lambda c, k: F.struct((F.col("shard").cast("long") * shard + k).alias("slot"), F.substring(c, k * (size + END) + 1, F.lit(size)).alias("payload"))
    cut = let(F.col("content"), lambda c: F.transform(places, lambda k: record(c, k)))
    return files.select(F.explode(cut).alias("r")).select("r.*")


def read_slot(spark: SparkSession, folder: str, slot: int, length: int = SEQUENCE, width: int = 2, shard: int = SHARD) -> np.ndarray:
    """The ids of one slot, by one seek in its file."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/shards/shard={slot // shard}")
    store = path.getFileSystem(hadoop)
    (file,) = [f.getPath() for f in store.listStatus(path) if f.getPath().getName().startswith("part-")]
    stream = store.open(file)
    try:
        stream.seek(slot % shard * (length * width + END))
        raw = jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length * width)
    finally:
        stream.close()
    return np.frombuffer(bytes(raw), f"<u{width}")
