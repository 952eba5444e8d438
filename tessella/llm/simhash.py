"""SimHash near-duplicates with pivot distance tables.

Equal fingerprints are one node.  For each node a table holds its Hamming distances to
``PIVOTS`` reference fingerprints; by the triangle inequality two nodes whose distances to any
pivot differ by more than the limit are further apart than the limit, so a pair is discarded by
its largest coordinate difference and only survivors are compared bit by bit.

Pairs are looked for inside buckets, since a distance table alone would need all pairs.

* By fingerprint (``near_duplicates``): a bucket holds nodes that agree on one of ``limit + 1`` parts of
  the free bits, which every pair within the limit does.  A bucket of more than ``BUCKET`` nodes is split
  again by parts of its free bits, which loses no pair; with 9 free bits it cannot hold more, so
  buckets are bounded whatever the data.  A bucket lies in order of the distance to one pivot, and
  a node is held against those after it up to the limit, so the table gives the pairs.
* By similarity (``deduplicate``): texts link when the sets of their 5-word shingles have a similarity of
  0.8 or more.  That is some 10 bits of 64, up to ``WIDE`` of them, where parts of bits are too short
  to tell texts apart; so buckets are MinHash bands.  Pairs fall by the distance table and the fingerprints,
  then by sizes and parity bits, which lose no similar pair, and survivors are verified by their whole sets.
  Dense buckets are first joined by stars around changing centres, so that pairs that are connected
  already need no row; pairs of different components are all looked at in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import shingles
from tessella.llm.blocks import bound_batches, release
from tessella.llm.components import components, durable
from tessella.llm.exprs import col, fresh, refuse

WORDS, SEED = 3, 42
LIMIT = 2
PIVOTS = 16
BUCKET = 512
#: Shingles that are hashed and summed at once.
CHUNK = 255 * 400
#: Bits that fingerprints of sets with a similarity of 0.8 differ in at most; more has a chance of about 1e-6.
WIDE = 24
#: A band of more components than DENSE gives a star in place of all pairs, in STARS rounds at most.
DENSE, STARS = 64, 3


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8)).view(np.uint64).reshape(-1, 8)  # a byte for each bit
        full = len(bits) // 255 * 255
        for rows in (bits[:full].reshape(-1, 255, 8), bits[None, full:]):  # up to 255 rows add up within their bytes
            ones += rows.sum(1, dtype=np.uint64).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return ones


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint_of(text: str) -> int:
    """The signed 64-bit fingerprint of one text; without words 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        part = words[start : start + CHUNK + WORDS - 1]
        found = map(b" ".join, zip(*(part[k:] for k in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
        ones += _ones(np.array([digest(s, SEED) for s in found], np.uint64))
    return _majority(ones, n)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a long; null is as an empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t or "") for t in texts], dtype="int64")
        release()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(text)


def pivot_values() -> list[int]:
    """The reference fingerprints, as signed 64-bit numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED)).astype(np.int64)) for k in range(PIVOTS)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the distances of fp to the pivots, eight to a long (near, far)."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivot_values()]
    packed = [reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(d, 8 * k) for k, d in enumerate(distance[i : i + 8]))) for i in range(0, PIVOTS, 8)]
    return nodes.withColumns({"near": packed[0], "far": packed[1]})


def _parts(mask: int, n: int) -> list[int]:
    """The mask together with each of ``n`` parts of the bits that it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed((mask | sum(1 << b for b in part.tolist())) & (2**64 - 1)) for part in np.array_split(free, n)]


def _by_bucket(of: list[str], work):
    """A function of batches whose rows come bucket by bucket (equal columns ``of``): whole buckets to ``work``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = np.logical_and.reduce([batch[c].to_numpy() == batch[c].iat[-1] for c in of])
            cut = int(np.argmax(last))
            if cut or (rest and any(rest[-1][c].iat[-1] != batch[c].iat[-1] for c in of)):
                yield work(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True))
                rest = []
            rest.append(batch.iloc[cut:])
        if rest:
            yield work(pd.concat(rest, ignore_index=True))
        release()

    return run


def _table(rows: pd.DataFrame) -> np.ndarray:
    """The distances to the pivots, a row for each node."""
    return np.ascontiguousarray(rows[["near", "far"]].to_numpy()).view(np.int8)


def _edges(limit: int):
    """Edges that join what the pairs of each bucket join.  A bucket's rows are in order of ``near``."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        mask, value = rows["mask"].to_numpy(), rows["value"].to_numpy()
        fp, table = rows["fp"].to_numpy(), _table(rows)
        lead = rows["near"].to_numpy() >> 56  # the distance that the rows are in order of
        parent = list(range(len(fp)))
        joined = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        i = np.arange(len(fp))
        for step in range(1, len(fp)):
            i = i[: np.searchsorted(i, len(fp) - step)]
            j = i + step
            # What lies beyond the bucket or the limit at this step does so at every further one.
            i = i[(mask[i] == mask[j]) & (value[i] == value[j]) & (lead[j] - lead[i] <= limit)]
            if not len(i):
                break
            j = i + step
            near = np.abs(table[i] - table[j]).max(1) <= limit
            a, b = i[near], j[near]
            close = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= limit
            for x, y in zip(a[close].tolist(), b[close].tolist()):
                u, v = root(x), root(y)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    joined.append((x, y))
        x, y = np.array(joined, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": fp[x], "b": fp[y]})

    return _by_bucket(["mask", "value"], work)


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all pairs at ``limit`` or fewer bits.

    They are pairs within the limit, at most one fewer than its nodes from each bucket: enough for
    the components, without all pairs of a dense group.  A limit beyond 5 would need too many buckets.
    """
    if not 0 <= limit <= 5:
        raise ValueError(f"a limit from 0 to 5 bits, not {limit}")
    rows = durable(pivot_table(nodes.select("fp"))).withColumn("mask", F.lit(0).cast("long"))
    parents, found = [0], None
    while True:
        children = {m: _parts(m & (2**64 - 1), limit + 1) for m in parents}
        parts = F.create_map(*(x for m, own in children.items() for x in (F.lit(m).cast("long"), F.array(*(F.lit(c).cast("long") for c in own)))))
        rows = rows.select("fp", "near", "far", F.explode(parts[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        hot = durable(rows.groupBy("mask", "value").count().where(F.col("count") > BUCKET).select("mask", "value"))
        last = hot.isEmpty()
        ready = rows if last else rows.join(hot, ["mask", "value"], "left_anti")
        dealt = ready.repartition("mask", "value").sortWithinPartitions("mask", "value", "near")
        edges = durable(dealt.mapInPandas(_edges(limit), "a long, b long"))
        found = edges if found is None else found.unionByName(edges)
        if last:
            return found
        rows = durable(rows.join(hot, ["mask", "value"], "left_semi"))
        parents = [c for own in children.values() for c in own]


def _groups(signed: DataFrame) -> DataFrame:
    """fp, root and component_id of each fingerprint of ``signed`` (key, fp)."""
    nodes = durable(signed.groupBy("fp").agg(F.min("key").alias("least_key")))
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least_key").alias("component_id"))
    return durable(placed.join(least, "root").select("fp", "root", "component_id"))


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return durable(docs.select(col(key).alias("key"), fingerprint(col(text)).alias("fp")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: the key, fp (long), root (long) and component_id.

    Rows link when their fingerprints differ in 2 or fewer bits; component_id is the smallest key
    of all that can be reached, itself included (nulls count as none; null if there is no other).
    root names the component also then.  Null texts and texts without words have fingerprint 0, and link
    alike; texts are read whole, repeated rows have a row each, an empty table gives none, and other
    columns aren't looked at.
    """
    refuse((key,), "fp", "root", "component_id")
    signed = _signed(docs, key, text)
    return signed.join(_groups(signed), "fp").select(F.col("key").alias(key), "fp", "root", "component_id")


# --- by the similarity of whole sets


SIGNED = "node long, n long, fp long, parity binary, bands array<long>"


def _sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = [shingles.shingles(t) for t in texts]
        yield pd.DataFrame(
            {
                "node": pd.Series([shingles.node_of(s) for s in sets], dtype="int64"),
                "n": pd.Series([len(s) for s in sets], dtype="int64"),
                "fp": pd.Series([_majority(_ones(s), len(s)) for s in sets], dtype="int64"),
                "parity": pd.Series([shingles.parity_of(s) for s in sets], dtype=object),
                "bands": pd.Series([shingles.bands_of(s) for s in sets], dtype=object),
            }
        )
    release()


_sign.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose band another row has too.  Rows come in order of band."""
    last: pd.DataFrame | None = None  # the row before, which may have been passed on already
    passed = False
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
        band = rows["band"].to_numpy()
        same = np.concatenate([[False], band[1:] == band[:-1]])
        keep = same.copy()
        keep[:-1] |= same[1:]
        last, was = rows.iloc[-1:], passed
        passed = bool(keep[-1])
        if was:
            keep[0] = False
        yield rows[keep]
    release()


CANDIDATES = "a long, b long, a_key string, a_th long, b_key string, b_th long"


def _candidates(stars: bool):
    """Pairs of different labels of each band that the tables, fingerprints, sizes or parity bits don't rule out.

    With ``stars`` a band of more than DENSE labels gives its first row's pairs alone, and a row without a
    and b, which says so.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        band, node, label, n, fp = (rows[c].to_numpy() for c in ("band", "node", "label", "n", "fp"))
        table = _table(rows)
        bits = np.frombuffer(b"".join(rows["parity"]), np.uint64).reshape(len(rows), shingles.PARITY // 64)
        cuts = np.flatnonzero(np.diff(band)) + 1
        found, dense = [], 0
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(band)]):
            labels = len(np.unique(label[s:e]))
            if labels < 2:
                continue
            star = stars and labels > DENSE
            dense += star
            for i in range(s, s + 1 if star else e - 1):
                j = np.arange(i + 1, e)
                j = j[label[j] != label[i]]
                j = j[np.abs(table[j] - table[i]).max(1, initial=0) <= WIDE]
                j = j[np.bitwise_count((fp[j] ^ fp[i]).view(np.uint64)) <= WIDE]
                j = j[5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])]
                j = j[9 * np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= n[i] + n[j]]
                if len(j):
                    found.append(np.stack([np.full(len(j), i), j]))
        a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        out = {f"{x}{c}": rows[of].to_numpy()[at] for c, of in (("", "node"), ("_key", "key"), ("_th", "th")) for x, at in (("a", a), ("b", b))}
        pairs = pd.DataFrame(out).drop_duplicates(["a", "b"]).astype({c: "Int64" for c in ("a", "b", "a_th", "b_th")})
        if dense:
            pairs = pd.concat([pairs, pd.DataFrame({c: [None] for c in pairs.columns}).astype(pairs.dtypes)], ignore_index=True)
        return pairs[[c.split()[0] for c in CANDIDATES.split(", ")]]

    return _by_bucket(["band"], work)


def similar_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the similar pairs of ``nodes`` (node, n, fp, parity, bands, key, th) connect."""
    banded = nodes.select("node", F.explode("bands").alias("band")).repartition("band").sortWithinPartitions("band")
    shared = durable(banded.mapInPandas(_shared, "node long, band long"))
    rows = durable(shared.join(pivot_table(nodes.drop("bands")), "node"))
    edges, label, stars, most = None, None, STARS, 0
    while True:
        named = rows.withColumn("label", F.col("node")) if label is None else rows.join(label, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        dealt = named.withColumn("at", F.xxhash64("node", F.lit(stars))).repartition("band").sortWithinPartitions("band", "at").drop("at")
        found = durable(dealt.mapInPandas(_candidates(stars > 0), CANDIDATES).dropDuplicates(["a", "b"]))
        new = shingles.verified(found.where("a is not null"), texts)
        edges = new if edges is None else edges.unionByName(new)
        if found.where("a is null").isEmpty():
            return edges
        label, gained = durable(components(edges)), new.count()
        most = max(most, gained)
        stars = stars - 1 if 100 * gained >= most else 0  # stars that join little more give way to all pairs


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group stays, one with the smallest key; all columns are kept, whatever their names.

    Rows link when the sets of their 5-word shingles (lower-cased; fewer words are one shingle) have a
    Jaccard similarity of 0.8 or more.  Null texts and texts without words are one group.  Of several
    rows with the smallest key any one stays; a group without keys keeps one of its rows.  Texts are read
    whole; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    t = col(text)
    texts = docs.select(col(key).cast("string").alias("key"), F.xxhash64(t, F.octet_length(t)).alias("th"), t.alias("text"))
    rows = docs.select(col(key).alias("key"), F.xxhash64(t, F.octet_length(t)).alias("th"), t.alias("text"))
    signed = durable(rows.select("key", "th", F.pandas_udf(_sign, SIGNED)("text").alias("s")).select("key", "th", "s.*"))
    # The first of a node's rows by key stands for it; nulls come last.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("row")
    nodes = durable(signed.groupBy("node").agg(first, *(F.any_value(c).alias(c) for c in ("n", "fp", "parity", "bands"))).select("node", "n", "fp", "parity", "bands", "row.key", "row.th"))
    roots = components(similar_links(nodes.withColumn("key", F.col("key").cast("string")), texts))
    placed = nodes.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("key").alias("component_id"))
    groups = durable(placed.join(least, "root").select("node", "root", "component_id"))
    own = signed.select("key", "th", "node").join(groups, "node")
    if signed.groupBy("key").count().where("count > 1 or key is null").isEmpty():
        (k,) = fresh(docs.columns, "__key")
        return docs.join(own.where("key <> component_id").select(F.col("key").alias(k)), col(key) == F.col(k), "left_anti")
    # Keys that repeat don't tell rows apart, so rows are matched by their texts.
    h, r, c = fresh(docs.columns, "__hash", "__root", "__least")
    named = own.groupBy("th").agg(F.any_value("root").alias(r), F.any_value("component_id").alias(c)).withColumnRenamed("th", h)
    kept = docs.join(named, F.xxhash64(t, F.octet_length(t)) == F.col(h)).where(col(key).eqNullSafe(F.col(c))).dropDuplicates([r])
    return kept.select(*(col(x) for x in docs.columns))
