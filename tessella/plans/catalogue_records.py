"""Queries over records: alignment lines, interval algebra and orders, annotation lines, sequences and strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import cigar, intervals, sequences, strings
from tessella.operators import fragments, ranges
from tessella.plans.registry import query
from tessella.plans.views import EXONS, READS, exons, reads, table
from tessella.sources import alignments, gtf

#: CIGARs of the made alignment lines; in the SQL: whether a read is kept, its span, its length, and whether it is spliced.
CIGARS = ["50M", "10M30N20M", "10M2I30M", "2I40M", "20M10N30M", "30M40N20M5D20M", "0M40M", "20M5=10M", "1M", "5S40M3H", "20M400000N10M", "20M25N10M2I20M"]


@query("""
, c(k, ok, span, len, spliced) AS (VALUES (0, true, 50, 50, false), (1, true, 60, 30, true), (2, false, 0, 0, false), (3, false, 0, 0, false), (4, false, 0, 0, false), (5, true, 115, 70, true),
(6, false, 0, 0, false), (7, false, 0, 0, false), (8, false, 0, 0, false), (9, true, 40, 45, false), (10, false, 0, 0, false), (11, true, 75, 52, true)),
r AS (SELECT *, id * 7 % 512 AS flag, CASE WHEN id % 7 = 0 THEN 1 ELSE nh END AS hits FROM reads JOIN c ON c.k = id % 12)
SELECT 'r' || id AS name, ref, "left", "left" + span - 1 AS "right", len_1 AS read_len, spliced, CASE WHEN flag & 1 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS mass,
CASE WHEN id % 5 = 0 THEN '+' WHEN id % 5 = 1 THEN '-' WHEN (flag & 64 <> 0) <> (flag & 16 <> 0) THEN '+' ELSE '-' END AS strand,
flag & 64 <> 0 AS first, flag & 128 <> 0 AS second, flag & 16 <> 0 AS reverse, (id % 9)::INT AS zf, id % 61 >= 10 AS good
FROM (SELECT * RENAME (len AS len_0) FROM (SELECT r.* EXCLUDE (len), r.len AS len, c.len AS len_1 FROM r JOIN c ON c.k = r.k)) WHERE ok AND flag & 4 = 0 AND flag & 256 = 0 AND hits <= 1""", READS)
def sam_filter(spark, sf_dir):
    """Alignment lines made from events, parsed and filtered as a run does."""
    r = reads(spark, sf_dir)
    flag = F.col("id") * 7 % 512
    paired = flag.bitwiseAND(1) != 0
    kinds = F.array(*map(F.lit, CIGARS))
    tags = F.concat(
        F.when(F.col("id") % 5 == 0, "\tXS:A:+").when(F.col("id") % 5 == 1, "\tXS:A:-").otherwise(""),
        F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("\tNH:i:"), F.col("nh").cast("string"))),
        F.concat(F.lit("\tZF:i:"), (F.col("id") % 9).cast("string")),
    )
    fields = [F.concat(F.lit("r"), "id"), flag, F.col("ref"), F.col("left"), F.col("id") % 61, F.get(kinds, (F.col("id") % 12).cast("int")), F.when(paired, "=").otherwise("*"), F.when(paired, F.col("left") + 100).otherwise(0), F.lit(0), F.lit("*"), F.lit("*")]
    line = F.concat(F.concat_ws("\t", *(f.cast("string") for f in fields)), tags)
    head = spark.createDataFrame([("@SQ\tSN:x\tLN:1",)], "value string")
    rows = alignments.parse_sam(head.unionByName(r.select(line.alias("value")))).withColumn("ops", cigar.parse(F.col("cigar")))
    kept = rows.where(cigar.mapped(F.col("flag"), F.col("ref")) & cigar.valid_cigar(F.col("ops")) & cigar.unique_hit(F.col("flag"), F.col("nh")))
    single = F.col("mate_ref").isNull() | (F.col("mate_left") == 0)
    has = lambda bit: cigar.has(F.col("flag"), bit)
    return kept.select(
        "name", "ref", "left", (F.col("left") + cigar.reference_span(F.col("ops")) - 1).alias("right"), cigar.read_length(F.col("ops")).alias("read_len"), cigar.spliced(F.col("ops")).alias("spliced"),
        cigar.mass(single, F.col("nh")).alias("mass"), cigar.strand(F.col("xs"), F.col("flag"), "fr").alias("strand"), has(cigar.FIRST).alias("first"), has(cigar.SECOND).alias("second"), has(cigar.REVERSE).alias("reverse"), "zf", (F.col("mapq") >= 10).alias("good"),
    )


PAIRED = """WITH p AS (SELECT l_linenumber::BIGINT * 10 AS l1, l_linenumber::BIGINT * 10 + trunc(l_quantity)::BIGINT AS r1, l_suppkey % 60 AS l2, l_suppkey % 60 + l_partkey % 30 AS r2, ['+', '-', '?'][l_orderkey % 3 + 1] AS s1, ['+', '-', '?'][l_partkey % 3 + 1] AS s2 FROM lineitem),
q AS (SELECT *, s1 = s2 OR s1 = '?' OR s2 = '?' AS agree, l1 <= r2 AND l2 <= r1 AS touch FROM p)
"""


@query(PAIRED + """SELECT l1, r1, l2, r2, s1, s2, touch AND agree AS overlap_on_strand, touch AND s1 = s2 AS overlap_directed, l1 - 2 <= l2 AND r2 <= r1 + 2 AS contains_slack, l1 <= l2 AND r2 <= r1 AND agree AS contains_on_strand,
(l1 < l2 AND r2 <= r1) OR (l1 <= l2 AND r2 < r1) AS contains_properly, l1 = l2 AND r1 = r2 AND agree AS equal, CASE WHEN touch THEN least(r1, r2) - greatest(l1, l2) + 1 ELSE 0 END AS shared,
CASE WHEN r1 + 1 > l2 AND l1 < r2 THEN CASE WHEN l1 > l2 THEN CASE WHEN r1 + 1 <= r2 + 1 THEN r1 - l1 + 1 ELSE r2 - l1 END WHEN r1 + 1 <= r2 + 1 THEN r1 + 1 - l2 ELSE r2 - l2 END ELSE 0 END AS matched,
r1 + 1 AS stop, r1 + 5 < l2 AS before, l1 > r2 + 5 AS after, NOT (r1 + 5 < l2) AND NOT (l1 > r2 + 5) AS near, least(l1, r2) AS low, greatest(l1, r2) AS high, r1 - l1 + 1 AS size FROM q""")
def interval_algebra(spark, sf_dir):
    """Every predicate and measure of two intervals, over the order lines."""
    sign = lambda c: F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("?")), (F.col(c) % 3 + 1).cast("int"))
    start, other = F.col("l_linenumber").cast("long") * 10, F.col("l_suppkey").cast("long") % 60
    p = table(spark, sf_dir, "lineitem").select(start.alias("l1"), (start + F.col("l_quantity").cast("long")).alias("r1"), other.alias("l2"), (other + F.col("l_partkey") % 30).alias("r2"), sign("l_orderkey").alias("s1"), sign("l_partkey").alias("s2"))
    l1, r1, s1, l2, r2, s2 = (F.col(c) for c in ("l1", "r1", "s1", "l2", "r2", "s2"))
    touch = intervals.overlaps(l1, r1, l2, r2)
    return p.select(
        "l1", "r1", "l2", "r2", "s1", "s2", intervals.overlaps_on_strand(l1, r1, s1, l2, r2, s2).alias("overlap_on_strand"), intervals.overlaps_directed(l1, r1, s1, l2, r2, s2).alias("overlap_directed"),
        intervals.contains(l1, r1, l2, r2, slack=2).alias("contains_slack"), intervals.contains_on_strand(l1, r1, s1, l2, r2, s2).alias("contains_on_strand"), intervals.properly_contains(l1, r1, l2, r2).alias("contains_properly"),
        intervals.equal_on_strand(l1, r1, s1, l2, r2, s2).alias("equal"), F.when(touch, intervals.overlap_length_or_fail(l1, r1, l2, r2)).otherwise(0).alias("shared"), intervals.match_length(l1, r1 - l1 + 1, l2, r2).alias("matched"),
        intervals.to_half_open(l1, r1)["stop"].alias("stop"), intervals.before_group(l1, r1, l2, 5).alias("before"), intervals.after_group(l1, r2, 5).alias("after"), intervals.near_group(l1, r1, l2, r2, 5).alias("near"),
        intervals.normalised(l1, r2)["left"].alias("low"), intervals.normalised(l1, r2)["right"].alias("high"), intervals.length(l1, r1).alias("size"),
    )


@query("""SELECT id, row_number() OVER (PARTITION BY ref ORDER BY "left", "right", id) AS place, coalesce("left" = lead("left") OVER w AND "right" = lead("right") OVER w AND (strand = lead(strand) OVER w OR strand = '?' OR lead(strand) OVER w = '?'), false) AS equals_next
FROM reads WINDOW w AS (PARTITION BY ref ORDER BY "left", "right", id)""", READS)
def interval_order(spark, sf_dir):
    """Intervals in order of place, and whether the next one is equal, where an unknown strand equals any."""
    w = Window.partitionBy("ref").orderBy("left", "right", "id")
    nexts = [F.lead(c).over(w) for c in ("left", "right", "strand")]
    equal = intervals.equal_on_strand(F.col("left"), F.col("right"), F.col("strand"), *nexts)
    return reads(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("place"), F.coalesce(equal, F.lit(False)).alias("equals_next"))


@query("""
, t AS (SELECT locus, transcript, list(["left", "right" - "left", "right"] ORDER BY "left", "right") AS e FROM exons GROUP BY ALL)
SELECT locus, transcript, dense_rank() OVER (PARTITION BY locus ORDER BY e) AS place, count(*) OVER (PARTITION BY locus, e) AS n_equal FROM t""", EXONS)
def contig_order(spark, sf_dir):
    """Transcripts of a locus in order of their features, equal ones at one place."""
    e = F.array_sort(F.collect_list(F.array("left", F.col("right") - F.col("left"), "right"))).alias("e")
    t = exons(spark, sf_dir).groupBy("locus", "transcript").agg(e)
    w = Window.partitionBy("locus").orderBy("e")
    return t.select("locus", "transcript", F.dense_rank().over(w).cast("long").alias("place"), F.count("*").over(Window.partitionBy("locus", "e")).alias("n_equal"))


INTRON_SETS = """, i AS (SELECT locus, transcript, "right" + 1 AS "left", lead("left") OVER (PARTITION BY locus, transcript ORDER BY "left", "right") - 1 AS "right" FROM exons),
s AS (SELECT locus, transcript, list(DISTINCT [("left" // 100) * 100, ("right" // 100) * 100 + 99] ORDER BY [("left" // 100) * 100, ("right" // 100) * 100 + 99]) AS chain FROM i WHERE "right" >= "left" GROUP BY locus, transcript)
"""


@query(INTRON_SETS + """SELECT a.locus, a.transcript AS small, b.transcript AS large FROM s a JOIN s b ON a.locus = b.locus AND a.transcript <> b.transcript AND list_has_all(b.chain, a.chain)""", EXONS)
def intron_containment(spark, sf_dir):
    """Pairs of transcripts where every rough intron of the one is one of the other; they meet at the first."""
    i = ranges.introns(exons(spark, sf_dir), ["locus", "transcript"])
    rough = F.array(F.floor(F.col("left") / 100) * 100, F.floor(F.col("right") / 100) * 100 + 99)
    s = i.groupBy("locus", "transcript").agg(F.array_sort(F.collect_set(rough)).alias("chain"))
    large = s.select("locus", F.col("transcript").alias("large"), F.col("chain").alias("of"), F.explode("chain").alias("key"))
    pairs = s.withColumn("key", F.col("chain")[0]).join(large, ["locus", "key"]).where("transcript <> large")
    return pairs.where(intervals.intron_subset(F.col("chain"), F.col("of"))).select("locus", F.col("transcript").alias("small"), "large")


@query("""SELECT item_id, text[5 : 16] AS part, text[3 : 8] || text[15 : 20] || text[40 : 41] AS spliced FROM benchmark""")
def sequence_fetch(spark, sf_dir):
    block = lambda a, b: F.struct(F.lit(a).cast("long").alias("left"), F.lit(b).cast("long").alias("right"))
    blocks = F.array(block(3, 8), block(15, 20), block(40, 41))
    return table(spark, sf_dir, "benchmark").select("item_id", sequences.fetch(F.col("text"), F.lit(5), F.lit(12)).alias("part"), sequences.spliced_sequence(F.col("text"), blocks).alias("spliced"))


@query("""
WITH s AS (SELECT item_id, translate(upper(regexp_replace(text, '[^ACGTacgt]', 'A', 'g')), 'ACGT', '0123') AS q FROM benchmark),
k AS (SELECT item_id, q[i]::INT * 64 + q[i + 1]::INT * 16 + q[i + 2]::INT * 4 + q[i + 3]::INT AS v FROM s, unnest(range(1, length(q) - 2)) AS r(i))
SELECT item_id, string_agg(v::VARCHAR, ',' ORDER BY v) AS packed FROM k GROUP BY item_id""")
def packed_kmers(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(sequences.packed_kmers(F.col("text"), 4), ",").alias("packed"))


@query("""SELECT c_custkey, lower(c_mktsegment) = lower(c_name) AS same, printf('%x', c_custkey) AS hex, c_name AS file, '/data/' || c_custkey || '/' AS dir, CASE c_mktsegment WHEN 'Illumina' THEN 'ILLUMINA' WHEN 'SOLiD' THEN 'SOLID' ELSE 'UNKNOWN' END AS platform FROM customer""")
def path_functions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/data/"), F.col("c_custkey").cast("string"), F.lit("/"), F.col("c_name"))
    return c.select("c_custkey", strings.equal_ignoring_case(F.col("c_mktsegment"), F.col("c_name")).alias("same"), strings.in_base(F.col("c_custkey"), 16).alias("hex"), strings.file_name(path).alias("file"), strings.dir_name(path).alias("dir"), strings.platform(F.col("c_mktsegment")).alias("platform"))


TREE = """, t AS (SELECT locus, transcript, list(DISTINCT ["left", "right"] ORDER BY ["left", "right"]) AS e FROM exons GROUP BY ALL)
"""


def _annotation(spark, sf_dir):
    """Annotation lines of the exons: from the last to the first, twice, with comments and lines of other types."""
    e = exons(spark, sf_dir)
    text = ("chr", "locus", "\tx\texon\t", "right", "\t", "left", '\t.\t-\t.\tgene_id "g', "locus", '"; transcript_id "t', "transcript", '"; gene_name "n', "locus", '";')
    line = F.concat(*(F.col(x).cast("string") if x in e.columns else F.lit(x) for x in text))
    own = e.select(line.alias("value"))
    noise = e.select(F.concat(F.lit("chr1\tx\tregion\t1\t9\t.\t+\t.\tID=r"), F.col("transcript").cast("string")).alias("value")).unionByName(spark.createDataFrame([("# a comment line",), ("short",), ("chr1\tx\texon\tnone\t9\t.\t+\t.\tID=q",)], "value string"))
    return gtf.parse(own.unionByName(own).unionByName(noise))


@query(TREE + """SELECT 'chr' || locus AS chrom, 'g' || locus AS gene_id, 't' || transcript AS transcript_id, 'n' || locus AS gene_name, len(e)::INT AS n_exons, e[1][1] AS "left", e[-1][2] AS "right", list_aggregate(list_transform(e, lambda x: x[2] - x[1] + 1), 'sum')::BIGINT AS length FROM t""", EXONS)
def gtf_tree(spark, sf_dir):
    """Transcripts of annotation lines, their exons in order and each once."""
    t = gtf.transcripts(_annotation(spark, sf_dir))
    features = F.transform("exons", lambda x: F.struct(F.lit("S").alias("code"), x["left"].alias("left"), x["right"].alias("right")))
    return t.select("chrom", "gene_id", "transcript_id", "gene_name", F.size("exons").alias("n_exons"), fragments.left(features).alias("left"), fragments.right(features).alias("right"), fragments.exonic_length(features).alias("length"))


@query("""
, k AS (SELECT DISTINCT c_custkey % 500 AS locus FROM customer)
SELECT DISTINCT 'CHR' || locus AS chrom, 't' || transcript AS transcript_id FROM exons JOIN k USING (locus)""", EXONS)
def gtf_load(spark, sf_dir):
    """Transcripts on known references, whose names match whatever their case."""
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("CHR"), (F.col("c_custkey") % 500).cast("string")).alias("ref")).distinct()
    return gtf.load_annotation(_annotation(spark, sf_dir), known).select("chrom", "transcript_id")


@query("""
, g AS (SELECT locus, "left", "right" FROM exons GROUP BY ALL), t AS (SELECT locus, count(DISTINCT transcript) AS n FROM exons GROUP BY locus)
SELECT 'g' || locus AS gene_id, min("left") AS "left", max("right") AS "right", count(*)::INT AS n_exons, max(n)::INT AS n_transcripts FROM g JOIN t USING (locus) GROUP BY locus""", EXONS)
def gtf_genes(spark, sf_dir):
    """Genes with their ends, and their exons each once."""
    return gtf.genes(gtf.transcripts(_annotation(spark, sf_dir))).select("gene_id", "left", "right", F.size("exons").alias("n_exons"), F.size("transcripts").alias("n_transcripts"))


@query("""
, k AS (SELECT DISTINCT c_custkey % 400 AS locus FROM customer)
SELECT 'chr' || locus AS chrom, count(DISTINCT transcript) AS n_transcripts FROM exons ANTI JOIN k USING (locus) GROUP BY locus""", EXONS)
def gtf_unknown(spark, sf_dir):
    """Transcripts on chromosomes that aren't known."""
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("CHR"), (F.col("c_custkey") % 400).cast("string")).alias("ref")).distinct()
    return gtf.unknown(_annotation(spark, sf_dir), known)
