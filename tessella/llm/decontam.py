"""Benchmark decontamination in DataFrame operations alone.

The benchmark's windows (10 normalised words, or a whole shorter item) are a small table, joined
to the windows of every document by their text, so a hit needs no further check.  To join only a
few of a document's windows, each document row first tests the hash of a window's leading words
against a bitmap of the benchmark's, which can let a window through but never lose one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import durable
from tessella.llm.exprs import col, fresh, let, literal_array, lower_ascii, refuse, words_between

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Leading words that are hashed.
LEAD = 3
#: Words of 64 bits in the bitmap: a quarter of the windows, in powers of two within these bounds (128 KB,
#: 4 MB).  A fuller bitmap lets more windows through to the join, and loses none.
LEAST_BITMAP, MOST_BITMAP = 1 << 14, 1 << 19
#: The table of windows is broadcast up to so many rows (about 100 bytes each), and shuffled beyond.
BROADCAST_WINDOWS = 200_000


def normal_words(text: Column) -> Column:
    return words_between(lower_ascii(text), SEPARATORS)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """win, n_words, lead (hash of the leading words), items (sorted strings; a null id is 'null')."""

    def cut(words: Column) -> Column:
        n = F.least(F.size(words), F.lit(WINDOW))
        at = F.when(n > 0, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i, n), " ").alias("win"), n.alias("n_words"), _lead(F.transform(F.slice(words, i, F.least(n, F.lit(LEAD))), lambda w: F.xxhash64(w))).alias("lead")))

    cuts = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.explode_outer(let(normal_words(F.col(f"`{text}`")), cut)).alias("w"))
    return cuts.where("w.win is not null").groupBy("w.win", "w.n_words", "w.lead").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _lead(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def contamination(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id") -> DataFrame:
    """A row for each row of ``docs``: the keys, text_hash, n_words, spans of hit words, items.

    spans are array<struct<start,stop>> of word positions from 0, disjoint and in order; items are
    the sorted ids of items with a window in the text.  Null and empty texts have no words and no
    hits.  Rows with equal keys and equal texts get equal results; keys may be null.  Texts are read
    whole; an empty table of documents gives none, an empty benchmark no hits.  Other columns aren't looked at.
    """
    refuse(keys, "text_hash", "n_words", "spans", "items")
    windows = durable(benchmark_windows(benchmark, item))
    facts = windows.groupBy().agg(F.count("*").alias("n"), F.array_sort(F.collect_set("n_words")).alias("lengths")).first()
    lengths, size = facts["lengths"], LEAST_BITMAP
    while size < min(MOST_BITMAP, facts["n"] // 4):
        size *= 2

    def slot(lead: Column) -> Column:
        return F.shiftrightunsigned(lead, 6).bitwiseAND(size - 1).cast("int")

    bits = windows.groupBy(slot(F.col("lead")).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lead").bitwiseAND(63).cast("int"))).alias("bits"))
    table = [0] * size
    for row in bits.collect():  # at most ``size`` rows
        table[row["slot"]] = row["bits"]
    bitmap = literal_array(table if facts["n"] else [0], "long")
    if facts["n"] <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)

    def known(lead: Column) -> Column:
        return F.getbit(F.get(bitmap, slot(lead)), lead.bitwiseAND(63).cast("int")) == 1

    def candidates(words: Column, hashes: Column) -> Column:
        """Windows whose leading words may be those of a benchmark window."""
        found = []
        for lead in sorted({min(n, LEAD) for n in lengths}):
            starts = let(F.transform(hashes, lambda h, i: F.when(known(_lead(F.array(h, *(F.get(hashes, i + k) for k in range(1, lead))))), i)), lambda at: F.filter(at, lambda i: i.isNotNull()))
            for n in (n for n in lengths if min(n, LEAD) == lead):
                inside = F.filter(starts, lambda i: i + n <= F.size(words))
                found.append(F.transform(inside, lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("win"), i.alias("start"), (i + n).alias("stop"))))
        return F.concat(*found) if found else F.array().cast("array<struct<win:string,start:int,stop:int>>")

    def scan(words: Column) -> Column:
        base = F.struct(F.lit(None).cast("string").alias("win"), F.lit(None).cast("int").alias("start"), F.size(words).alias("stop"))
        return F.concat(F.array(base), let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: candidates(words, hashes)))

    t = col(text)
    named = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(*(col(k).alias(n) for k, n in zip(keys, named)), F.xxhash64(t, F.octet_length(t)).alias("text_hash"), F.explode_outer(let(normal_words(t), scan)).alias("w"))
    # A row for the document itself joins nothing; its key differs from row to row, so a shuffled join deals it evenly.
    joined = rows.withColumn("win", F.coalesce("w.win", F.concat(F.lit("\0"), F.hex("text_hash")))).join(windows.select("win", "items"), "win", "left")
    hit = joined.where("w.win is null or items is not null")
    own = F.col("w.win").isNull()
    grouped = hit.groupBy(*named, "text_hash").agg(
        F.sum(own.cast("int")).alias("copies"),
        F.max(F.when(own, F.col("w.stop"))).cast("long").alias("n_words"),
        F.collect_set(F.when(~own, F.struct("w.start", "w.stop"))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda s: F.sequence(s["start"], s["stop"] - 1)))))

    def merge(at: Column) -> Column:
        starts = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
        stops = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))

    merged = grouped.withColumn("spans", let(places, merge)).withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return merged.select(*(F.col(n).alias(k) for k, n in zip(keys, named)), "text_hash", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` without its contaminated documents, or without their hit spans (``remove="spans"``).

    A span goes with the separators inside it; the rest of the text stays as it is, in its own
    case.  All columns of ``docs`` are kept, whatever their names; documents without a hit, null
    texts among them, are unchanged.
    """
    t = col(text)
    k, h, spans = fresh(docs.columns, "__key", "__hash", "__spans")
    found = contamination(docs.select(col(key).alias("key"), t.alias("text")), benchmark, ("key",), "text").where(F.size("spans") > 0)
    hits = found.select(F.col("key").alias(k), F.col("text_hash").alias(h), F.col("spans").alias(spans)).dropDuplicates([k, h])
    match = F.col(h).eqNullSafe(F.xxhash64(t, F.octet_length(t))) & F.col(k).eqNullSafe(col(key))
    if remove == "documents":
        return docs.join(hits, match, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    separators = SEPARATORS.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")

    def cut(pieces: Column) -> Column:
        first = F.when(F.get(pieces, F.lit(0)).rlike(f"^{separators}"), 1).otherwise(0)  # words and separators alternate
        inside = lambda s, i: (i >= 2 * s["start"] + first) & (i <= 2 * s["stop"] - 2 + first)
        return F.array_join(F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: inside(s, i))), "")

    pieces = F.regexp_extract_all(t, F.lit(f"({separators}|{separators.replace('[', '[^', 1)})"), F.lit(1))
    cleaned = docs.join(hits, match, "left").withColumn(text, F.when(F.col(spans).isNull(), t).otherwise(let(pieces, cut)))
    return cleaned.select(*(col(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS r(i)),
h AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
"""
