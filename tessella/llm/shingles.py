"""Sets of word shingles: names, MinHash bands, parity bits, and the exact similarity of pairs.

Used by the SimHash operator where rows link by the similarity of their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import release
from tessella.llm.components import durable

WORDS, SEED = 5, 42
#: A pair shares none of BANDS bands of ROWS MinHash values with a chance of (1 - 0.8 ** 5) ** 32, 3e-6, at 0.8.
BANDS, ROWS = 32, 5
#: Bits of parity of a node, and shingles whose MinHash values are taken at once.
PARITY, CHUNK = 512, 2048
#: Centres' sets are dealt to so many rows, since one centre can have very many pairs.
SALT = 16
#: Rows whose sets are asked for are broadcast up to so many (about 40 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 300_000

_RANDOM = np.random.default_rng(SEED)
_TIMES, _PLUS = _RANDOM.integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 2**63, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in runs], np.uint64))


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def bands_of(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for s in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[s : s + CHUNK] * _TIMES + _PLUS).min(1))
    mixed = least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))
    return ((mixed * _MIX[:ROWS]).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[ROWS]).view(np.int64)


def parity_of(found: np.ndarray) -> bytes:
    """Of each of PARITY classes of hashes, whether the set holds an odd number."""
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).tobytes()


def _made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingles(t).tobytes() for t in texts], dtype=object)
    release()


_made.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}


def sets_of(texts: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """node and shingles of the wanted nodes, ``most`` rows at most.

    texts: key (as a string), th, text; wanted: node, and the key and th of one of its rows.  Sets are made
    from the texts anew, of that row alone: kept sets of all rows would be as large as the input.
    """
    wanted = wanted.select("node", F.col("key").alias("own"), F.col("th").alias("own_th"))
    if most <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, F.col("key").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th")))
    return rows.select("node", F.pandas_udf(_made, "binary")("text").alias("shingles")).dropDuplicates(["node"])


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose similarity is 0.8 or more: 9 times what they share against 4 times both sizes.

    Rows come by (a, salt), that of a's own set (without b) first.
    """
    held, of = np.zeros(0, np.uint64), None
    for batch in batches:
        out = []
        for a, salt, b, raw in zip(batch["a"].tolist(), batch["salt"].tolist(), batch["b"].tolist(), batch["shingles"]):
            own = np.frombuffer(raw, np.uint64)
            if of != (a, salt):
                held, of = own, (a, salt)
            elif 9 * len(np.intersect1d(held, own, assume_unique=True)) >= 4 * (len(held) + len(own)):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    release()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of 0.8 or more.

    pairs: a, b, and the key and th of a row of each (a_key, a_th, b_key, b_th), each pair once.  The set of
    ``a`` goes to its pairs once for each of SALT parts, so a node may have very many.
    """
    of = lambda x: pairs.select(F.col(x).alias("node"), F.col(f"{x}_key").alias("key"), F.col(f"{x}_th").alias("th"))
    held = durable(sets_of(texts, of("a").union(of("b")).dropDuplicates(["node"]), 2 * pairs.count()))
    salted = pairs.select("a", F.pmod(F.hash("b"), F.lit(SALT)).alias("salt"), "b")
    first = salted.select("a", "salt").distinct().join(held.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).cast("long").alias("b"), "shingles", F.lit(0).alias("late"))
    others = salted.join(held.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "shingles", F.lit(1).alias("late"))
    dealt = first.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "late").drop("late")
    return durable(dealt.mapInPandas(_similar, "a long, b long"))
