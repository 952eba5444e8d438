"""Queries over quantification: effective lengths, bin weights and counts, and expectation-maximisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import abundance, joins
from tessella.plans.registry import query
from tessella.plans.views import BLOCKS, EXONS, READS, blocks, exons, reads, table

FRAGMENT, READ = 60, 10
TRIPLES = """, x AS (SELECT transcript, "right" - "left" + 1 AS a, lead("right" - "left" + 1) OVER w AS b, lead("right" - "left" + 1, 2) OVER w AS c FROM exons WINDOW w AS (PARTITION BY transcript ORDER BY "left", "right")),
y AS (SELECT *, i, 60 - i - b AS last FROM x, unnest(range(1, a + 1)) AS r(i) WHERE c IS NOT NULL),
z AS (SELECT *, (10 - i > 0) OR (10 - last > 0) AS inner_hit FROM y WHERE last BETWEEN 1 AND c)
"""


@query(TRIPLES + """SELECT x.transcript, x.a, x.b, x.c, (SELECT count(*) FROM range(1, x.a + 1) AS r(i) WHERE 30 - i BETWEEN 1 AND x.b) AS two, coalesce(q.seen, 0) AS three, coalesce(q.skipped, 0) AS three_skipped, greatest(x.a - 60 + 1, 0) AS one
FROM x LEFT JOIN (SELECT transcript, a, b, c, sum(inner_hit::INT)::BIGINT // count(DISTINCT k) AS seen, sum((NOT inner_hit)::INT)::BIGINT // count(DISTINCT k) AS skipped FROM (SELECT *, 1 AS k FROM (SELECT DISTINCT transcript, a, b, c, i, inner_hit FROM z)) GROUP BY ALL) q ON q.transcript = x.transcript AND q.a = x.a AND q.b = x.b AND q.c = x.c WHERE x.c IS NOT NULL""", EXONS)
def bin_effective_length(spark, sf_dir):
    """Start positions of fragments over one, two and three neighbouring exons, the middle one hit by a read or skipped."""
    order = Window.partitionBy("transcript").orderBy("left", "right")
    size = F.col("right") - F.col("left") + 1
    rows = exons(spark, sf_dir).select("transcript", size.alias("a"), F.lead(size).over(order).alias("b"), F.lead(size, 2).over(order).alias("c")).where("c is not null")

    @F.pandas_udf("one long, two long, three long, three_skipped long")
    def effective(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        each = [(abundance.effective_length([x], set(), FRAGMENT, READ), abundance.effective_length([x, y], set(), 30, READ), abundance.effective_length([x, y, z], set(), FRAGMENT, READ), abundance.effective_length([x, y, z], {1}, FRAGMENT, READ)) for x, y, z in zip(a, b, c)]
        return pd.DataFrame(each, columns=["one", "two", "three", "three_skipped"])

    return rows.withColumn("e", effective("a", "b", "c")).select("transcript", "a", "b", "c", "e.*")


@query("""
WITH l AS (SELECT trunc(l_quantity)::BIGINT AS a, l_partkey % 50 + 1 AS b, l_suppkey % 30 AS m, l_orderkey % 90 + 5 AS f, l_orderkey % 17 + 1 AS r FROM lineitem), g AS (SELECT *, f - 2 * r AS gap FROM l)
SELECT a, b, m, f, r, CASE WHEN f < m + 2 OR f > a + b + m THEN 0 ELSE least(a, f - m - 1) + least(b, f - m - 1) - (f - m - 1) END AS both_ends,
CASE WHEN 2 * r + gap < m + 2 OR 2 * r + gap > a + b + m THEN 0 ELSE greatest(least(a, a + b + m - gap - r) - greatest(r, a + m - gap - 1), 0) END AS both_ends_only FROM g""")
def gap_effective_length(spark, sf_dir):
    """Closed forms of the start positions over two segments."""
    one = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("a"), (F.col("l_partkey") % 50 + 1).alias("b"), (F.col("l_suppkey") % 30).alias("m"), (F.col("l_orderkey") % 90 + 5).alias("f"), (F.col("l_orderkey") % 17 + 1).alias("r"))
    a, b, m, f, r = (F.col(c) for c in "abmfr")
    return one.select("a", "b", "m", "f", "r", abundance.both_ends(a, b, m, f).alias("both_ends"), abundance.both_ends_only(a, b, m, r, f - 2 * r).alias("both_ends_only"))


@query("""
, x AS (SELECT locus, transcript, "left", "right", "right" - "left" + 1 AS size, row_number() OVER w AS k, lead("right" - "left" + 1) OVER w AS next, sum("right" - "left" + 1) OVER (PARTITION BY locus, transcript) AS len FROM exons WINDOW w AS (PARTITION BY locus, transcript ORDER BY "left", "right")),
f AS (SELECT *, fl, exp(-power((fl - 40) / 15, 2) / 2) / (15 * sqrt(2 * pi())) AS p FROM x, unnest(range(10, 131)) AS r(fl) WHERE next IS NOT NULL AND fl <= size + next AND fl <= len)
SELECT locus, transcript, k, round(sum(p * greatest(least(size, fl - 1) - greatest(1, fl - next) + 1, 0) / (len - fl + 1)), 9) AS weight FROM f GROUP BY ALL""", EXONS)
def bin_weights(spark, sf_dir):
    """The weight of each transcript's bins of two neighbouring exons, from a normal fragment length."""
    rows = exons(spark, sf_dir).groupBy("locus", "transcript").agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("own"))
    length = F.aggregate("own", F.lit(0).cast("long"), lambda a, s: a + s["right"] - s["left"] + 1)
    touched = F.explode(F.transform(F.slice("own", 1, F.size("own") - 1), lambda s, i: F.struct((i + 1).cast("long").alias("k"), F.array(s, F.get("own", i + 1)).alias("t"))))
    each = rows.where(F.size("own") > 1).select("locus", "transcript", "own", length.alias("len"), touched.alias("b")).withColumn("u", abundance.under_isoform(F.col("own"), F.col("b.t")))
    weight = abundance.bin_weights(F.col("u.lengths"), F.col("u.implicit"), F.col("len"), READ, abundance.normal_density(40.0, 15.0, 130))
    return each.where("len >= 10 and u.lengths[0] + u.lengths[1] >= 10").select("locus", "transcript", "b.k", F.round(weight, 9).alias("weight"))


@query(BLOCKS + """, p AS (SELECT b.locus, b."left" AS spot, b.n, x."left", x."right" FROM b JOIN exons x ON b.locus = x.locus AND x."left" <= b."right" AND b."left" <= x."right"),
k AS (SELECT locus, spot, n, list(DISTINCT ["left", "right"] ORDER BY ["left", "right"]) AS s FROM p GROUP BY locus, spot, n)
SELECT locus, array_to_string(list_transform(s, lambda x: x[1] || '-' || x[2]), ',') AS bin, len(s)::INT AS n_segments, list_aggregate(list_transform(s, lambda x: x[2] - x[1] + 1), 'sum')::BIGINT AS bin_length, sum(n)::BIGINT AS n_reads, count(*) AS n_fragments, round(sum(n * 5) / sum(n), 6) AS mean_length FROM k GROUP BY locus, s""", EXONS)
def bin_counts(spark, sf_dir):
    """Bins with their segments, lengths, reads and mean fragment length."""
    pairs = joins.interval_join(blocks(spark, sf_dir), exons(spark, sf_dir), ["locus"], bin_width=100)
    each = pairs.groupBy("locus", "left", "right", "n").agg(F.array_sort(F.collect_set(F.struct(F.col("b_left").alias("left"), F.col("b_right").alias("right")))).alias("s"))
    size = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["right"] - x["left"] + 1)
    name = F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["left"], x["right"])), ",")
    mean = F.sum(F.col("n") * (F.col("right") - F.col("left") + 1)) / F.sum("n")
    return each.groupBy("locus", "s").agg(F.sum("n").alias("n_reads"), F.count("*").alias("n_fragments"), F.round(mean, 6).alias("mean_length")).select("locus", name.alias("bin"), F.size("s").alias("n_segments"), size.alias("bin_length"), "n_reads", "n_fragments", "mean_length")


@query("""
, f AS (SELECT len FROM reads ORDER BY id LIMIT 1000)
SELECT arg_min(len, (-n, len)) AS mode, sum(n)::BIGINT AS n_inspected, count(*) FILTER (len > 200) AS n_long FROM (SELECT len, count(*) AS n FROM f GROUP BY len)""", READS)
def inspected_lengths(spark, sf_dir):
    """The most frequent length of the first thousand reads; the limit is the feature."""
    counts = reads(spark, sf_dir).orderBy("id").limit(1000).groupBy("len").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("len", F.struct(-F.col("n"), "len")).alias("mode"), F.sum("n").alias("n_inspected"), F.count_if(F.col("len") > 200).alias("n_long"))


@query()
def em_abundance(spark, sf_dir):
    """EM over the sets of transcripts of a locus that hold the same reads, weighed by 1/length."""
    e = exons(spark, sf_dir).withColumnRenamed("transcript", "isoform")
    return abundance.em_contained(e, blocks(spark, sf_dir))
