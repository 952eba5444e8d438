"""Quality rules in DataFrame operations alone: base rules and an n-gram log-likelihood ratio.

One- and two-word n-grams are hashed to a fixed number of buckets.  Their counts over trusted
documents (labelled as good) and over the whole corpus give two smoothed multinomials; a
document's score is the mean log ratio of its n-grams, so long and short texts compare.  The
ratios are one row of ``BUCKETS`` numbers (512 KB), which the second pass has as a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.exprs import BLANKS, col, let, literal_array, words_between

BUCKETS = 1 << 16
#: Pseudo-occurrences that draw a bucket's trusted count to the one expected from the corpus, so
#: that words too rare to tell, such as those of a document without a label, weigh little.
SMOOTHING = 20.0
#: A document is kept from this mean log ratio on.
THRESHOLD = -0.06
#: Trusted ids are broadcast up to so many (16 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000
SYMBOLS = "[#*$%&|<>]"


def grams(words: Column) -> Column:
    """The buckets of all one- and two-word n-grams, in order of the text."""

    def both(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: _bucket(F.xxhash64(x, F.get(h, i + 1))))
        return F.concat(F.transform(h, _bucket), pairs)

    return let(F.transform(words, lambda w: F.xxhash64(w)), both)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: ratios, array<double> of log(trusted share / corpus share) by bucket.

    trusted has a column ``key``; its nulls and repeats count for nothing.  Shares are
    smoothed towards the corpus; without trusted documents every ratio is 0.
    """
    ids = trusted.select(col(key).alias("__id")).where("__id is not null").distinct().withColumn("__trusted", F.lit(1))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    flagged = docs.select(col(key).alias("__id"), col(text).alias("t")).join(ids, "__id", "left")
    each = flagged.select("__trusted", F.explode(grams(words_between(F.col("t"), BLANKS))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__trusted").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").fillna(0)
    listed = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))), lambda c: F.struct(c["raw"].alias("raw"), c["target"].alias("target"))).alias("m"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))

    def ratio(c: Column) -> Column:
        share = F.when(F.col("raw") > 0, c["raw"] / F.col("raw")).otherwise(0.0)
        return F.log((c["target"] + F.lit(SMOOTHING)) / (F.col("target") * share + F.lit(SMOOTHING)))

    return listed.select(F.transform("m", ratio).alias("ratios"))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = let(order, lambda s: F.filter(s, lambda x, j: same(s, x, j + 1) | same(s, x, j - 1)))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` and struct ``out``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    log_ratio (double; 0 without words) and kept.  Every row is judged by its own text, so repeated
    rows get equal verdicts; null and empty texts have no words and fail the base rules.  Texts are read
    whole, an empty table gives an empty one, and a column that is named ``out`` is replaced.
    """
    t = F.coalesce(col(text), F.lit(""))
    ratios = literal_array(log_ratios(docs, trusted, key, text).first()["ratios"], "double")
    lines = let(F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")), lambda own: F.size(own) - F.size(F.array_distinct(own)))

    def facts(words: Column) -> Column:
        mean = let(grams(words), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.size(g)).otherwise(0.0))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            mean.alias("log_ratio"),
        )

    judged = let(let(words_between(col(text), BLANKS), facts), lambda f: _verdict(f, threshold))
    return docs.withColumn(out, judged)


def _verdict(f: Column, threshold: float) -> Column:
    failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return F.struct(*(f[n].alias(n) for n in names), failed.alias("base_failed"), f["log_ratio"].alias("log_ratio"), (~failed & (f["log_ratio"] >= threshold)).alias("kept"))
