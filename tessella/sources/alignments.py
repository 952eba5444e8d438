"""Alignments as a DataFrame: text SAM by Spark's reader, BAM by a Python data source.

Columns: name, flag, ref, left (1-based), mapq, cigar (string), mate_ref, mate_left, seq, xs, nm, nh, zf.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, flag int, ref string, left long, mapq int, cigar string, mate_ref string, mate_left long, seq string, xs string, nm int, nh int, zf int"
#: The same for Arrow, and records of a batch.
ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]]) for f in SCHEMA.split(", ")])
BATCH = 8192
#: Operation letters and base letters by their codes in a record.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Sizes of the tag types that have one.
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
MAX_HEADER = 4 << 20


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of a text file; header lines are left out."""
    return parse_sam(spark.read.text(path))


def parse_sam(text: DataFrame) -> DataFrame:
    """Records of lines in a column ``value``; header lines and empty ones are left out."""
    lines = text.where(~F.col("value").startswith("@") & (F.length("value") > 0))
    f = F.split("value", "\t")
    none = lambda c: F.nullif(c, F.lit("*"))

    def tag(name: str, kind: str):
        return F.nullif(F.regexp_extract("value", f"\t{name}:{kind}:([^\t]*)", 1), F.lit(""))

    ref = none(f[2])
    return lines.select(
        f[0].alias("name"), f[1].try_cast("int").alias("flag"), ref.alias("ref"), f[3].try_cast("long").alias("left"), f[4].try_cast("int").alias("mapq"), f[5].alias("cigar"),
        F.when(f[6] == "=", ref).otherwise(none(f[6])).alias("mate_ref"), f[7].try_cast("long").alias("mate_left"), none(f[9]).alias("seq"),
        tag("XS", "A").alias("xs"), tag("NM", "i").try_cast("int").alias("nm"), tag("NH", "i").try_cast("int").alias("nh"), tag("ZF", "i").try_cast("int").alias("zf"),
    )


#: Fixed value: the empty block that ends a complete file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


#: Bytes of compressed blocks that a task reads, and records that must follow one another where a start is looked for.
SPLIT, CHAIN = 64 << 20, 5


def _member(f, path: str) -> tuple[int, int] | None:
    """Size of the block that starts here and of its header; None at the file's end."""
    head = f.read(12)
    if not head:
        return None
    extra = f.read(struct.unpack("<H", head[10:12])[0]) if len(head) == 12 else b""
    at, size = 0, None
    while at + 4 <= len(extra):
        a, b, n = struct.unpack("<BBH", extra[at : at + 4])
        if (a, b) == (66, 67):
            size = struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
        at += 4 + n
    if len(head) < 12 or len(extra) < struct.unpack("<H", head[10:12])[0]:
        raise ValueError(f"{path}: ends inside a block")
    if size is None:
        raise ValueError(f"{path}: not a blocked gzip file")
    return size, 12 + len(extra)


def splits(path: str, size: int) -> list[tuple[int, int]]:
    """Ranges of whole blocks of about ``size`` bytes.  Only block headers are read; a file that ends early is an error."""
    cuts, at, length = [0], 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while found := _member(f, path):
            at += found[0]
            if at > length:
                raise ValueError(f"{path}: ends inside a block")
            if at - cuts[-1] >= size and at < length:
                cuts.append(at)
            f.seek(at)
        f.seek(max(0, length - len(END_BLOCK)))
        if f.read() != END_BLOCK:
            raise ValueError(f"{path}: the end block is missing")
    return list(zip(cuts, [*cuts[1:], length]))


def inflate(path: str, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """Blocks from one that starts at ``start`` on: where each starts, and its content.  A file that ends early is an error."""
    with open(path, "rb") as f:
        f.seek(start)
        last = b""
        while found := _member(f, path):
            body = f.read(found[0] - found[1])
            if len(body) < found[0] - found[1]:
                raise ValueError(f"{path}: ends inside a block")
            last = body
            yield start, zlib.decompress(body[:-8], -15)
            start += found[0]
        if not END_BLOCK.endswith(last) or not last:
            raise ValueError(f"{path}: the end block is missing")


class _Stream:
    """Bytes taken from blocks, and the block that the next one comes from."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]):
        self.blocks, self.buffer, self.at = blocks, b"", 0
        self.starts: list[tuple[int, int]] = []  # of the buffer's parts: place in it, and block

    def fill(self) -> bool:
        more = next(self.blocks, None)
        if more is None:
            return False
        gone = self.at
        self.starts = [(p - gone, block) for k, (p, block) in enumerate(self.starts) if k + 1 == len(self.starts) or self.starts[k + 1][0] > gone]
        self.buffer, self.at = self.buffer[gone:], 0
        self.starts.append((len(self.buffer), more[0]))
        self.buffer += more[1]
        return True

    def block(self) -> int | None:
        """Where the block of the next byte starts; None at the end."""
        while self.at >= len(self.buffer):
            if not self.fill():
                return None
        return max(block for place, block in self.starts if place <= self.at)

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or none at the end; an end inside them is an error."""
        while len(self.buffer) - self.at < n:
            if not self.fill():
                if len(self.buffer) > self.at:
                    raise ValueError("the file ends inside a record")
                return b""
        self.at += n
        return self.buffer[self.at - n : self.at]

    def seek_record(self, refs: int) -> None:
        """Go on to the first byte at which a chain of sound records starts."""
        while True:
            end = self._chain(self.at, refs)
            if end is not None:
                return
            self.at += 1

    def _chain(self, at: int, refs: int) -> int | None:
        for _ in range(CHAIN):
            while len(self.buffer) - at < 36:
                before = self.at
                if not self.fill():
                    return at if len(self.buffer) == at else None
                at -= before - self.at
            size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", self.buffer[at : at + 36])
            sound = -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and n_name > 0 and n_seq >= 0
            if not sound or size < 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq:
                return None
            while len(self.buffer) - at < 36 + n_name:
                before = self.at
                if not self.fill():
                    return None
                at -= before - self.at
            name = self.buffer[at + 36 : at + 36 + n_name]
            if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
                return None
            at += 4 + size
        return at


def header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """The header's text, and the references' names and lengths."""
    return _header(_Stream(inflate(path)))


def _header(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    size = struct.unpack("<i", stream.take(4))[0]
    if size > MAX_HEADER:
        raise ValueError("the header is too large")
    text = stream.take(size).decode().rstrip("\0")
    refs = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        n = struct.unpack("<i", stream.take(4))[0]
        refs.append((stream.take(n)[:-1].decode(), struct.unpack("<i", stream.take(4))[0]))
    return text, refs


def platform(text: str) -> str | None:
    """The sequencing platform that a header's first read group names."""
    for line in text.splitlines():
        if line.startswith("@RG"):
            for part in line.split("\t"):
                if part.startswith("PL:"):
                    return part[3:]
    return None


def tags(data: bytes) -> dict[str, object]:
    """The tags of a record that are letters, numbers or strings."""
    found, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in SIZES:
            raw = data[at : at + SIZES[kind]]
            found[name] = raw.decode() if kind == "A" else struct.unpack(NUMBERS[kind], raw)[0]
            at += SIZES[kind]
        elif kind in "ZH":
            end = data.index(b"\0", at)
            found[name], at = data[at:end].decode(), end + 1
        else:
            each = SIZES[chr(data[at])]
            at += 5 + each * struct.unpack("<i", data[at + 1 : at + 5])[0]
    return found


def records(path: str, with_seq: bool = False, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """The records that start in blocks from ``start`` on and before ``stop``, which are starts of blocks."""
    stream = _Stream(inflate(path))
    _, refs = _header(stream)
    if start:
        first = stream.block()
        if first is None or first < start:
            stream = _Stream(inflate(path, start))
            stream.seek_record(len(refs))
    name_of = lambda k: refs[k][0] if k >= 0 else None
    while (stop is None or (stream.block() or 0) < stop) and (size := stream.take(4)):
        data = stream.take(struct.unpack("<i", size)[0])
        if not data:
            raise ValueError(f"{path}: the file ends inside a record")
        ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, _ = struct.unpack("<iiBBHHHiiii", data[:32])
        at = 32 + n_name
        ops = struct.unpack(f"<{n_ops}I", data[at : at + 4 * n_ops])
        at += 4 * n_ops
        packed = data[at : at + (n_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq] if with_seq else None
        own = tags(data[at + len(packed) + n_seq :])
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
        yield (data[32 : at - 4 * n_ops - 1].decode(), flag, name_of(ref), pos + 1, mapq, cigar, name_of(mate), mate_pos + 1, seq, own.get("XS"), own.get("NM"), own.get("NH"), own.get("ZF"))


class BamSource(DataSource):
    """``spark.read.format("bam")``; options path (comma-separated files, on a path that executors mount), seq and split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options)


class _BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.seq = options.get("seq", "false").lower() == "true"
        self.size = int(options.get("split", str(SPLIT)))

    def partitions(self):
        return [InputPartition((p, a, b)) for p in self.paths for a, b in splits(p, self.size)]

    def read(self, partition):
        """Arrow batches of records."""
        path, start, stop = partition.value
        rows = records(path, self.seq, start, stop)
        while part := list(itertools.islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*part), ARROW.types)], schema=ARROW)


def read_bam(spark: SparkSession, path: str, with_seq: bool = False) -> DataFrame:
    """Records of blocked gzip files, a task for each range of blocks."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("path", path).option("seq", str(with_seq).lower()).load()
