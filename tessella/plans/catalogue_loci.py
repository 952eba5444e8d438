"""Queries over loci: fragments, strand runs, junction depths, exon segments, joints, read paths and assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import cluster, fragments, introns, joins, ranges, segments, splice
from tessella.plans.registry import query
from tessella.plans.views import BLOCKS, EXONS, READS, ROUGH, blocks, exons, reads, rough_exons
from tessella.session import settled

NORMAL_CDF = "0.5 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-a * a)))"


def _mates(spark, sf_dir):
    """Every event as two mates; the first of every fourth pair is spliced."""
    r = reads(spark, sf_dir)
    away = F.when(F.col("id") % 4 == 0, 100).otherwise(10 + F.col("id") % 6 * 10)
    block = lambda code, a, b: F.struct(F.lit(code).alias("code"), (F.col("at") + a).alias("left"), (F.col("at") + b).alias("right"))
    plain, spliced = F.array(block("S", 0, 29)), F.array(block("S", 0, 9), block("I", 10, 49), block("S", 50, 69))
    both = r.select("ref", "id", "strand", "left", (F.col("left") + away).alias("mate"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    at = both.withColumn("at", F.when(F.col("k") == 0, F.col("left")).otherwise(F.col("mate"))).withColumn("mate_left", F.when(F.col("k") == 0, F.col("mate")).otherwise(F.col("left")))
    rows = at.withColumn("features", F.when((F.col("id") % 4 == 0) & (F.col("k") == 0), spliced).otherwise(plain))
    strand = F.when(F.col("k") == 0, F.lit("?")).otherwise(F.col("strand"))
    return rows.select("ref", F.col("id").alias("name"), (F.col("id") * 2 + F.col("k")).alias("id"), F.col("at").alias("left"), fragments.right(F.col("features")).alias("right"), strand.alias("strand"), F.lit(0.5).alias("mass"), "mate_left", "features")


@query("""
, p AS (SELECT id, ref, strand, "left" AS l, "left" + CASE WHEN id % 4 = 0 THEN 100 ELSE 10 + id % 6 * 10 END AS m FROM reads),
f AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'S:' || l || '-' || (l + 9) || ' I:' || (l + 10) || '-' || (l + 49) || ' S:' || (l + 50) || '-' || (l + 69) || ' G:' || (l + 70) || '-' || (m - 1) || ' S:' || m || '-' || (m + 29)
WHEN m > l + 30 THEN 'S:' || l || '-' || (l + 29) || ' G:' || (l + 30) || '-' || (m - 1) || ' S:' || m || '-' || (m + 29) ELSE 'S:' || l || '-' || (m + 29) END AS chain FROM p WHERE m <> l + 30)
SELECT id * 2 AS id, ref, strand, 1.0::DOUBLE AS mass, chain, l AS "left", m + 29 AS "right", (CASE WHEN m > l + 30 THEN 60 ELSE m + 29 - l + 1 END)::BIGINT AS exonic, m <= l + 30 AS single,
(CASE WHEN id % 4 = 0 THEN m - l - 70 WHEN m > l + 30 THEN m - l - 30 ELSE 0 END)::BIGINT AS gap FROM f""", READS)
def fragment_pairs(spark, sf_dir):
    """Mates as fragments: with a gap between them, merged where they overlap, dropped where they only touch."""
    f = fragments.fragments(_mates(spark, sf_dir), ["ref"])
    chain = F.array_join(F.transform("features", lambda x: F.concat(x["code"], F.lit(":"), x["left"].cast("string"), F.lit("-"), x["right"].cast("string"))), " ")
    own, gap = F.col("features"), fragments.gap(F.col("features"))
    return f.select("id", "ref", "strand", "mass", chain.alias("chain"), fragments.left(own).alias("left"), fragments.right(own).alias("right"), fragments.exonic_length(own).alias("exonic"), fragments.is_single(own).alias("single"), F.coalesce(gap["right"] - gap["left"] + 1, F.lit(0)).alias("gap"))


@query("""
, c AS (SELECT ref, strand, "left" // 5000 AS place, count(*) AS n_reads, sum(12 // nh)::BIGINT AS mass, min(id) AS id FROM reads GROUP BY ALL)
SELECT ref, strand, place, n_reads, mass, id FROM c""", READS)
def fragment_collapse(spark, sf_dir):
    """Equal fragments as one."""
    place = F.floor(F.col("left") / 5000)
    features = F.array(F.struct(F.lit("S").alias("code"), place.alias("left"), (place + 1).alias("right")))
    rows = reads(spark, sf_dir).select("ref", "id", "strand", F.floor(12 / F.col("nh")).alias("mass"), features.alias("features"))
    return fragments.collapse(rows, ["ref"]).select("ref", "strand", F.col("left").alias("place"), "n_reads", "mass", "id")


@query("""
, r AS (SELECT *, max("right") OVER (PARTITION BY ref ORDER BY "left", "right", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR "left" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY "left", "right", id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r),
k AS (SELECT ref, run, ["left", "right", id] AS spot, (strand = '-')::INT AS label FROM c WHERE strand <> '?' AND id % 3 = 0),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY ref, run) AS n, sum(label) OVER w AS one, sum(label) OVER (PARTITION BY ref, run) AS ones, lead(spot) OVER w AS next FROM k WINDOW w AS (PARTITION BY ref, run ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, greatest(one, i - one) + greatest(ones - one, n - i - (ones - one)) AS score FROM o),
z AS (SELECT ref, run, arg_max(i, (score, i)) AS i, max(n) AS n, arg_max(spot, (score, i)) AS spot, arg_max(next, (score, i)) AS next, arg_max(label, (score, i)) AS label, arg_max(label, i) AS last FROM (SELECT * REPLACE (coalesce(next, spot) AS next) FROM s) GROUP BY ref, run),
j AS (SELECT c.*, z.i, z.n, z.spot, z.next, z.label, z.last, coalesce(z.i < z.n, false) AS cut, [c."left", c."right", c.id] AS here FROM c LEFT JOIN z USING (ref, run)),
p AS (SELECT ref, run, id, strand, 0 AS part, CASE WHEN cut THEN label ELSE last END AS sign FROM j WHERE NOT cut OR here < next UNION ALL SELECT ref, run, id, strand, 1, 1 - label FROM j WHERE cut AND here > spot)
SELECT ref, run::BIGINT AS run, id, part, CASE sign WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '?' END AS run_strand FROM p WHERE strand = '?' OR strand = CASE sign WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '?' END""", READS)
def strand_runs(spark, sf_dir):
    """Overlapping reads cut where the strands of the spliced ones change."""
    block = lambda code: F.struct(F.lit(code).alias("code"), F.col("left").alias("left"), F.col("right").alias("right"))
    features = F.when(F.col("id") % 3 == 0, F.array(block("S"), block("I"), block("S"))).otherwise(F.array(block("S")))
    rows = reads(spark, sf_dir).select("ref", "id", "left", "right", "strand", features.alias("features"))
    return fragments.strand_runs(rows, ["ref"]).select("ref", "run", "id", "part", "run_strand")


@query("""
, s AS (SELECT ref, "left" FROM reads WHERE len > 200)
SELECT r.id, count(s."left") AS after FROM reads r LEFT JOIN s ON r.ref = s.ref AND s."left" <= r."left" GROUP BY r.id""", READS)
def reads_after_starts(spark, sf_dir):
    """How many of some starts lie at or before each read: what caps a cluster at the next start."""
    r = reads(spark, sf_dir)
    return cluster.before_starts(r.select("ref", "id", "left"), r.where("len > 200"), ["ref"], "id").select("id", F.col("after").cast("long").alias("after"))


JUMPS = """, i AS (SELECT locus, transcript, CASE WHEN transcript % 2 = 0 THEN '+' ELSE '-' END AS strand, "right" + 1 AS "left", lead("left") OVER (PARTITION BY locus, transcript ORDER BY "left", "right") - 1 AS "right", least("right" - "left", lead("right" - "left") OVER (PARTITION BY locus, transcript ORDER BY "left", "right")) + 1 AS anchor FROM exons), j AS (SELECT * FROM i WHERE "right" >= "left")
"""


def _transcripts(spark, sf_dir):
    """Transcripts as fragments: their exons and the introns between them."""
    e = exons(spark, sf_dir).groupBy("locus", "transcript").agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("e"))
    part = lambda code, a, b: F.struct(F.lit(code).alias("code"), a.alias("left"), b.alias("right"))
    features = F.flatten(F.transform("e", lambda x, i: F.when(i == 0, F.array(part("S", x["left"], x["right"]))).otherwise(F.array(part("I", F.get("e", i - 1)["right"] + 1, x["left"] - 1), part("S", x["left"], x["right"])))))
    return e.select("locus", F.col("transcript").alias("id"), F.when(F.col("transcript") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(1).cast("long").alias("mass"), features.alias("features"))


@query(JUMPS + """, n AS (SELECT locus, strand, "left", "right", count(*) AS n, sum((anchor < 10)::INT)::BIGINT AS n_small FROM j GROUP BY ALL), s AS (SELECT locus, strand, sum(n)::BIGINT AS n, max(n) AS most FROM n GROUP BY ALL)
SELECT locus, coalesce(sum(n) FILTER (strand = '+'), 0)::BIGINT AS n_plus, coalesce(sum(n) FILTER (strand = '-'), 0)::BIGINT AS n_minus, arg_max(strand, (most, strand = '+')) AS strand,
least(coalesce(sum(n) FILTER (strand = '+'), 0), coalesce(sum(n) FILTER (strand = '-'), 0)) > trunc(greatest(coalesce(sum(n) FILTER (strand = '+'), 0), coalesce(sum(n) FILTER (strand = '-'), 0)) * 0.01) AS both_strands FROM s GROUP BY locus""", EXONS)
def locus_strand(spark, sf_dir):
    """The strand of a locus by its best supported junction, and whether both are seen."""
    jumps = fragments.anchored(_transcripts(spark, sf_dir), ["locus", "strand", "mass"]).where("code = 'I' and right >= left")
    return introns.locus_strand(jumps.select("locus", "strand", "left", "right", "mass"), ["locus"])


@query(JUMPS + """SELECT locus, strand, "left", "right", count(*) AS n_reads, sum((anchor < 10)::INT)::BIGINT AS n_small FROM j GROUP BY ALL""", EXONS)
def junction_anchors(spark, sf_dir):
    """Junctions by strand, and how many of their reads hold one by a short end."""
    jumps = fragments.anchored(_transcripts(spark, sf_dir), ["locus", "strand", "mass"]).where("code = 'I' and right >= left").withColumn("small", F.col("anchor") < 10)
    return introns.junction_counts(jumps, ["locus", "strand"], small="small")


RUNS = """, e AS (SELECT locus, "left" AS pos, 1 AS d FROM exons UNION ALL SELECT locus, "right" + 1, -1 FROM exons), g AS (SELECT locus, pos, sum(d) AS d FROM e GROUP BY locus, pos HAVING sum(d) <> 0),
w AS (SELECT locus, pos AS "left", lead(pos) OVER (PARTITION BY locus ORDER BY pos) - 1 AS "right", sum(d) OVER (PARTITION BY locus ORDER BY pos) AS depth FROM g), v AS (SELECT * FROM w WHERE depth > 0 AND "right" IS NOT NULL)
"""
PLACES = """, n AS (SELECT locus, "right" + 1 AS "left", nxt - 1 AS "right", count(*) AS n FROM (SELECT *, lead("left") OVER (PARTITION BY locus, transcript ORDER BY "left", "right") AS nxt FROM exons) WHERE nxt - 1 >= "right" + 1 GROUP BY ALL),
"""


@query(RUNS + PLACES + """d AS (SELECT n.locus, n."left", n."right", n.n, coalesce(sum(v.depth * (least(v."right", n."right" - 1) - greatest(v."left", n."left") + 1)), 0) AS inner_sum FROM n LEFT JOIN v ON v.locus = n.locus AND v."left" <= n."right" - 1 AND n."left" <= v."right" GROUP BY n.locus, n."left", n."right", n.n)
SELECT locus, "left", "right", inner_sum::DOUBLE AS inner_sum, (inner_sum = 0 OR n / ("right" - "left" + 1) * ("right" - "left") / inner_sum >= 0.01)::BOOLEAN AS deep FROM d WHERE "right" > "left"
""", EXONS)
def junction_depth(spark, sf_dir):
    """Exonic depth inside each junction but for its last position, and whether its own reads stand up to it."""
    e = exons(spark, sf_dir)
    j = ranges.introns(e, ["locus", "transcript"]).groupBy("locus", "left", "right").agg(F.count("*").alias("n")).where("right > left")
    depth = introns.inner_depth(j, ranges.coverage(e, ["locus"]), ["locus"], "inner_sum")
    size = F.col("right") - F.col("left")
    facts = depth.withColumn("own", F.col("n") / (size + 1)).withColumn("exonic", F.col("inner_sum") / size)
    deep = introns.deep_enough(facts, "own", "exonic", 0.01).select("locus", "left", "right", F.lit(True).alias("deep"))
    return depth.select("locus", "left", "right", "inner_sum").join(deep, ["locus", "left", "right"], "left").fillna(False, ["deep"])


@query(RUNS + PLACES + """c AS (SELECT n.locus, n."left", n."right", v.depth, least(v."right", n."right" - 1) - greatest(v."left", n."left") + 1 AS k FROM n JOIN v ON v.locus = n.locus AND v."left" <= n."right" - 1 AND n."left" <= v."right"),
z AS (SELECT locus, "left", "right", depth, k FROM c UNION ALL SELECT n.locus, n."left", n."right", 0, n."right" - n."left" + 1 - coalesce((SELECT sum(k) FROM c WHERE c.locus = n.locus AND c."left" = n."left" AND c."right" = n."right"), 0) FROM n),
y AS (SELECT locus, "left", "right", depth, sum(k) AS k FROM z GROUP BY locus, "left", "right", depth), u AS (SELECT *, sum(k) OVER (PARTITION BY locus, "left", "right" ORDER BY depth) AS upto, "right" - "left" + 1 AS size FROM y)
SELECT locus, "left", "right", ((min(depth) FILTER (upto > (size - 1) // 2)) + (min(depth) FILTER (upto > size // 2)))::DOUBLE / 2 AS median FROM u GROUP BY locus, "left", "right"
""", EXONS)
def junction_median(spark, sf_dir):
    """The median exonic depth inside each junction."""
    e = exons(spark, sf_dir)
    j = ranges.introns(e, ["locus", "transcript"]).select("locus", "left", "right").distinct()
    return introns.inner_median(j, ranges.coverage(e, ["locus"]), ["locus"], "median")


SEGMENTS = RUNS + PLACES.replace("GROUP BY ALL)", "GROUP BY ALL HAVING count(*) >= 2)") + """
ri AS (SELECT *, sum(CASE WHEN p IS NULL OR "left" > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY locus ORDER BY "left") AS k FROM (SELECT *, lag("right") OVER (PARTITION BY locus ORDER BY "left") AS p FROM v)),
isl AS (SELECT locus, min("left") AS "left", max("right") AS "right" FROM ri GROUP BY locus, k),
gp AS (SELECT *, lag("right") OVER (PARTITION BY locus ORDER BY "left") AS head FROM isl),
gj AS (SELECT gp.locus, gp."left", gp."right", gp.head, count(n."left") AS n_over, coalesce(bool_or(n."left" = gp.head + 1 AND n."right" = gp."left" - 1), false) AS fits FROM gp LEFT JOIN n ON n.locus = gp.locus AND n."left" <= gp."left" AND gp.head <= n."right" GROUP BY ALL),
gk AS (SELECT *, sum(CASE WHEN head IS NULL OR fits OR "left" - head >= CASE WHEN n_over > 0 THEN 10 ELSE 30 END THEN 1 ELSE 0 END) OVER (PARTITION BY locus ORDER BY "left") AS k FROM gj),
cov AS (SELECT locus, min("left") AS "left", max("right") AS "right", count(*) OVER (PARTITION BY locus) AS n_runs FROM gk GROUP BY locus, k),
cp AS (SELECT locus, "left" AS pos FROM n UNION SELECT locus, "right" + 1 FROM n),
st AS (SELECT locus, "left" AS pos, "right" AS stop, n_runs FROM cov UNION SELECT cov.locus, cp.pos, cov."right", n_runs FROM cov JOIN cp ON cp.locus = cov.locus AND cov."left" < cp.pos AND cp.pos <= cov."right"),
s0 AS (SELECT locus, pos AS "left", coalesce(lead(pos) OVER (PARTITION BY locus, stop ORDER BY pos) - 1, stop) AS "right", n_runs, EXISTS (SELECT 1 FROM n WHERE n.locus = st.locus) AS spliced FROM st),
s1 AS (SELECT * FROM s0 WHERE "right" > "left" AND (spliced OR n_runs = 1)),
s2 AS (SELECT s1.locus, s1."left", s1."right", s1.spliced, coalesce(sum(v.depth * (least(v."right", s1."right" - 1) - greatest(v."left", s1."left") + 1)), 0) / (s1."right" - s1."left") AS c FROM s1 LEFT JOIN v ON v.locus = s1.locus AND v."left" <= s1."right" - 1 AND s1."left" <= v."right" GROUP BY s1.locus, s1."left", s1."right", s1.spliced),
s3 AS (SELECT s2.locus, s2."left", s2."right", s2.spliced, s2.c, coalesce(max(n.n), 0) AS o FROM s2 LEFT JOIN n ON n.locus = s2.locus AND n."left" <= s2."right" AND s2."left" <= n."right" GROUP BY ALL),
md AS (SELECT locus, median(c) AS m FROM s3 WHERE c > o GROUP BY locus),
s4 AS (SELECT s3.* FROM s3 LEFT JOIN md USING (locus) WHERE NOT spliced OR NOT (c < o * 0.01 OR c < coalesce(m, 0) * 0.01)),
l1 AS (SELECT locus, "left", min("right") AS "right" FROM n GROUP BY ALL), l2 AS (SELECT locus, "right", min("left") AS "left" FROM n GROUP BY ALL),
s5 AS (SELECT s4.*, lag("right") OVER (PARTITION BY locus ORDER BY "left") AS pr, lead("left") OVER (PARTITION BY locus ORDER BY "left") AS nl, count(*) OVER (PARTITION BY locus) AS k FROM s4),
s6 AS (SELECT * FROM s5 x WHERE NOT spliced OR k = 1 OR EXISTS (SELECT 1 FROM l1 JOIN s4 y ON y.locus = l1.locus AND y."left" = l1."right" + 1 WHERE l1.locus = x.locus AND l1."left" = x."right" + 1)
OR EXISTS (SELECT 1 FROM l2 JOIN s4 y ON y.locus = l2.locus AND y."right" = l2."left" - 1 WHERE l2.locus = x.locus AND l2."right" = x."left" - 1) OR (coalesce(pr + 1 = "left", true) AND coalesce(nl = "right" + 1, true)))
"""


def _segments(spark, sf_dir):
    e = rough_exons(spark, sf_dir)
    j = ranges.introns(e, ["locus", "transcript"]).groupBy("locus", "left", "right").agg(F.count("*").alias("n_reads")).where("n_reads >= 2")
    return segments.parts(ranges.coverage(e, ["locus"]), j)


@query(SEGMENTS + """SELECT locus, 'segment' AS kind, "left", "right", round(c * ("right" - "left") / ("right" - "left" + 1), 6) AS n FROM s6
UNION ALL SELECT locus, 'junction', "left", "right", n::DOUBLE FROM n WHERE EXISTS (SELECT 1 FROM s6 WHERE s6.locus = n.locus AND s6."right" = n."left" - 1) AND EXISTS (SELECT 1 FROM s6 WHERE s6.locus = n.locus AND s6."left" = n."right" + 1)""", ROUGH)
def exon_segments(spark, sf_dir):
    """Segments of each locus with their depth, and the junctions between them."""
    return _segments(spark, sf_dir).withColumn("n", F.round("n", 6))


@query(SEGMENTS + """, t AS (SELECT locus, "right" AS pos, lead("left") OVER (PARTITION BY locus ORDER BY "left") AS nxt FROM s6)
SELECT t.locus, t.pos AS "at", count(*)::DOUBLE AS n FROM t JOIN exons x ON x.locus = t.locus AND x."left" <= t.pos - 5 AND x."right" >= t.pos + 6 WHERE nxt = t.pos + 1 GROUP BY t.locus, t.pos""", ROUGH)
def joint_support(spark, sf_dir):
    """Reads that span the joint of two touching segments."""
    found = settled(_segments(spark, sf_dir))
    return splice.joints(rough_exons(spark, sf_dir).withColumn("mass", F.lit(1)), found.where("kind = 'segment'"))


@query(SEGMENTS + """, o AS (SELECT locus, "left", "right", row_number() OVER (PARTITION BY locus ORDER BY "left") - 1 AS k FROM s6),
p AS (SELECT x.locus, x.transcript, list(DISTINCT o.k ORDER BY o.k) AS path FROM exons x JOIN o ON o.locus = x.locus AND o."left" <= x."right" AND x."left" <= o."right" GROUP BY x.locus, x.transcript)
SELECT DISTINCT locus, array_to_string(path, ',') AS path FROM p WHERE len(path) >= 3""", ROUGH)
def read_paths(spark, sf_dir):
    """The distinct lists of segments that fragments go through."""
    found = settled(_segments(spark, sf_dir))
    own = rough_exons(spark, sf_dir).withColumnRenamed("transcript", "id")
    return splice.read_paths(own, found.where("kind = 'segment'")).select("locus", F.array_join("path", ",").alias("path"))


@query()
def flow_assembly(spark, sf_dir):
    """Transcripts of each locus by minimum-cost flow over its splice graph."""
    found = settled(_segments(spark, sf_dir))
    cut = found.where("kind = 'segment'")
    own = rough_exons(spark, sf_dir).withColumnRenamed("transcript", "id").withColumn("mass", F.lit(1))
    return splice.assemble(found, splice.joints(own, cut), splice.read_paths(own, cut), least_length=50)


SPLICED = """, s AS (SELECT locus, "right" AS a, nxt AS b, count(*) AS n FROM (SELECT *, lead("left") OVER (PARTITION BY locus, transcript ORDER BY "left", "right") AS nxt FROM exons) WHERE nxt > "right" + 1 GROUP BY ALL)
"""


@query(SPLICED + """, x AS (SELECT *, lead("left") OVER w AS nl, lead("right") OVER w AS nr FROM exons WINDOW w AS (PARTITION BY locus, transcript ORDER BY "left", "right"))
SELECT s.locus, s.a, s.b, x.transcript FROM s JOIN x ON x.locus = s.locus AND x."right" = s.a AND x.nl = s.b AND x."left" <= s.a - 9 AND x.nr >= s.b + 9""", EXONS)
def spliced_compatibility(spark, sf_dir):
    """Reads of ten positions on both sides of a junction, and the transcripts that they follow."""
    t = _transcripts(spark, sf_dir)
    jumps = ranges.introns(exons(spark, sf_dir), ["locus", "transcript"]).select("locus", (F.col("left") - 1).alias("a"), (F.col("right") + 1).alias("b")).distinct()
    part = lambda code, x, y: F.struct(F.lit(code).alias("code"), x.alias("left"), y.alias("right"))
    read = F.array(part("S", F.col("a") - 9, F.col("a")), part("I", F.col("a") + 1, F.col("b") - 1), part("S", F.col("b"), F.col("b") + 9))
    # Read and transcript meet where they share the junction.
    have = t.select("locus", F.col("id").alias("transcript"), "features", F.explode(F.filter("features", lambda f: f["code"] == "I")).alias("i")).select("locus", "transcript", "features", (F.col("i.left") - 1).alias("a"), (F.col("i.right") + 1).alias("b"))
    return jumps.join(have, ["locus", "a", "b"]).where(joins.compatible(read, F.col("features"))).select("locus", "a", "b", "transcript")


@query(BLOCKS + """, x AS (SELECT *, coalesce(sum("right" - "left" + 1) OVER (PARTITION BY locus, transcript ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM exons)
SELECT x.locus, x.transcript, (x.before + b."left" - x."left" + 1)::BIGINT AS place, sum(b.n)::BIGINT AS n FROM b JOIN x ON b.locus = x.locus AND x."left" <= b."left" AND b."right" <= x."right" GROUP BY ALL""", EXONS)
def start_sites(spark, sf_dir):
    """Where reads start in each transcript that holds them."""
    whole = exons(spark, sf_dir).groupBy("locus", "transcript").agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("exons"))
    pairs = joins.interval_join(exons(spark, sf_dir), blocks(spark, sf_dir), ["locus"], predicate="contain", bin_width=100).select("locus", "transcript", "b_left", F.col("b_n").alias("n"))
    own = pairs.join(whole, ["locus", "transcript"])
    return own.groupBy("locus", "transcript", fragments.start_offset(F.col("exons"), F.col("b_left")).alias("place")).agg(F.sum("n").alias("n"))


@query(RUNS + """, x AS (SELECT f.locus, f.transcript, f."left", f."right", coalesce(sum(v.depth * (least(v."right", f."right" - 1) - greatest(v."left", f."left") + 1)), 0) / (f."right" - f."left" + 1) AS d FROM exons f LEFT JOIN v ON v.locus = f.locus AND v."left" <= f."right" - 1 AND f."left" <= v."right" GROUP BY f.locus, f.transcript, f."left", f."right")
SELECT locus, transcript, round(avg(d), 6) AS depth FROM x GROUP BY locus, transcript""", EXONS)
def transcript_depth(spark, sf_dir):
    """The mean of a transcript's exons' depths; an exon's leaves its last position out of the sum."""
    e = exons(spark, sf_dir)
    each = e.groupBy("locus", "left", "right").agg(F.collect_list("transcript").alias("t"))
    summed = introns.inner_depth(each.where("right > left"), ranges.coverage(e, ["locus"]), ["locus"], "s").unionByName(each.where("right = left").withColumn("s", F.lit(0.0)))
    rows = summed.select("locus", F.explode("t").alias("transcript"), (F.col("s") / (F.col("right") - F.col("left") + 1)).alias("d"))
    return rows.groupBy("locus", "transcript").agg(F.round(F.avg("d"), 6).alias("depth"))


@query("""
, m AS (SELECT ref, "left" // 20000 AS locus, count(*) AS n, sum(CASE WHEN nh = 1 THEN 1.0 ELSE 0.5 END / nh) AS mass FROM reads GROUP BY ALL)
SELECT sum(floor(mass))::BIGINT AS total, count(*) AS n_loci FROM m WHERE n >= 5""", READS)
def total_mapped(spark, sf_dir):
    """Mapped reads: whole masses of the loci of enough reads."""
    mass = F.when(F.col("nh") == 1, 1.0).otherwise(0.5) / F.col("nh")
    m = reads(spark, sf_dir).groupBy("ref", F.floor(F.col("left") / 20000).alias("locus")).agg(F.count("*").alias("n"), F.sum(mass).alias("mass"))
    return m.where("n >= 5").agg(F.sum(F.floor("mass")).alias("total"), F.count("*").alias("n_loci"))


@query("""
, x AS (SELECT *, lag("right") OVER w AS pr, lead("left") OVER w AS nl FROM exons WINDOW w AS (PARTITION BY locus, transcript ORDER BY "left", "right"))
SELECT locus, transcript, "left", coalesce(pr + 1 = "left", false) AS touches_before, coalesce("right" + 1 = nl, false) AS touches_after FROM x""", EXONS)
def neighbour_contiguity(spark, sf_dir):
    w = Window.partitionBy("locus", "transcript").orderBy("left", "right")
    return exons(spark, sf_dir).select("locus", "transcript", "left", F.coalesce(F.lag("right").over(w) + 1 == F.col("left"), F.lit(False)).alias("touches_before"), F.coalesce(F.col("right") + 1 == F.lead("left").over(w), F.lit(False)).alias("touches_after"))
