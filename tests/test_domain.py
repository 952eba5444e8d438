"""Fixtures worked out by hand, and properties of the solvers."""

import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import cigar, intervals, sequences, stats, strings
from tessella.operators import abundance, cluster, joins, ranges, splice
from tessella.plans import pipeline
from tessella.session import Options
from tessella.sources import alignments, fasta, gtf

TOY = """@SQ\tSN:ref\tLN:45
@SQ\tSN:ref2\tLN:40
r001\t163\tref\t7\t30\t8M4I4M1D3M\t=\t37\t39\tTTAGATAAAGAGGATACTG\t*
r002\t0\tref\t9\t30\t1S2I6M1P1I1P1I4M2I\t*\t0\t0\tAAAAGATAAGGGATAAA\t*
r003\t0\tref\t9\t30\t5H6M\t*\t0\t0\tAGCTAA\t*
r004\t0\tref\t16\t30\t6M14N1I5M\t*\t0\t0\tATAGCTCTCAGC\t*
r003\t16\tref\t29\t30\t6H5M\t*\t0\t0\tTAGGC\t*
r001\t83\tref\t37\t30\t9M\t=\t7\t-39\tCAGCGCCAT\t*
x1\t0\tref2\t1\t30\t20M\t*\t0\t0\tAGGTTTTATAAAACAAATAA\t*
x2\t0\tref2\t2\t30\t21M\t*\t0\t0\tGGTTTTATAAAACAAATAATT\t*
x3\t0\tref2\t6\t30\t9M4I13M\t*\t0\t0\tTTATAAAACAAATAATTAAGTCTACA\t*
x4\t0\tref2\t10\t30\t25M\t*\t0\t0\tCAAATAATTAAGTCTACAGAGCAAC\t*
x5\t0\tref2\t12\t30\t24M\t*\t0\t0\tAATAATTAAGTCTACAGAGCAACT\t*
x6\t0\tref2\t14\t30\t23M\t*\t0\t0\tTAATTAAGTCTACAGAGCAACTA\t*
"""


@pytest.fixture()
def toy(spark, tmp_path):
    path = tmp_path / "toy.sam"
    path.write_text(TOY)
    return alignments.read_sam(spark, str(path))


def test_toy_scan(toy):
    kept = {(r["name"], r["left"], r["right"]) for r in pipeline.valid_hits(toy, Options()).collect()}
    assert kept == {("r003", 9, 14), ("r003", 29, 33), ("r001", 37, 45), ("x1", 1, 20), ("x2", 2, 22), ("x4", 10, 34), ("x5", 12, 35), ("x6", 14, 36)}


def test_toy_run(toy):
    assert pipeline.run(toy, Options()).count() == 0  # 36 positions are too few
    rows = pipeline.run(toy, Options(min_transcript_length=1)).collect()
    assert [(r["chrom"], [tuple(e) for e in r["exons"]], r["TPM"]) for r in rows] == [("ref2", [(1, 36)], "1000000.000000")]
    assert abs(float(rows[0]["FPKM"]) - 27777777.7778) < 1e-3


def test_toy_quantify_only(toy, spark):
    given = spark.createDataFrame([("ref2", "+", "g", "t", [(1, 36)])], "chrom string, strand string, gene_id string, transcript_id string, exons array<struct<left:bigint,right:bigint>>")
    rows = pipeline.run(toy, Options(annotation="x.gtf", no_assembly=True), given).collect()
    assert [(r["transcript_id"], r["Frac"]) for r in rows] == [("t", "1.000000")]


def test_gap_boundary(spark):
    df = spark.createDataFrame([("a", 1, 1, 10), ("a", 2, 60, 65), ("a", 3, 116, 120)], "ref string, id int, left long, right long")
    rows = cluster.cluster_bounds(cluster.gap_cluster(df, ["ref"], "id"), ["ref"]).orderBy("left").collect()
    assert [(r["left"], r["right"], r["n_rows"]) for r in rows] == [(1, 65, 2), (116, 120, 1)]


def test_clusters_cross_blocks(spark):
    df = spark.createDataFrame([("a", 1, 999_990, 1_000_030), ("a", 2, 1_000_050, 2_000_100), ("a", 3, 2_000_120, 2_000_130), ("a", 4, 3_000_000, 3_000_001)], "ref string, id int, left long, right long")
    assert [r["cluster"] for r in cluster.gap_cluster(df, ["ref"], "id").orderBy("id").collect()] == [1, 1, 1, 2]


@pytest.mark.parametrize(("labels", "at"), [([0, 0, 0, 1, 1], 2), ([0, 1], 0), ([0, 0], 1), ([], -1)])
def test_split(spark, labels, at):
    df = spark.createDataFrame([(labels,)], "x array<int>")
    assert df.select(stats.split_score(F.col("x")).alias("at")).first()["at"] == at


def test_expressions(spark):
    one = spark.range(1)
    ends = [F.lit(x) for x in (5, 10, 8, 20)]
    row = one.select(
        intervals.overlap_length(*ends).alias("a"), intervals.overlap_span(*ends).alias("b"), sequences.kmer_entropy(F.lit("ACGTAC"), 3).alias("e"), sequences.gc_ratio(F.lit("ACGTAC")).alias("g"),
        stats.normal_cdf(F.lit(1.0)).alias("c"), strings.fnv1(F.lit("a")).alias("h"), sequences.packed_kmers(F.lit("ACGT"), 2).alias("k"), strings.in_base(F.lit(255), 16).alias("x"),
        cigar.total(cigar.parse(F.lit("5S10M2D3M")), "MD").alias("t"), sequences.gc_stretch(F.lit("AAGGGA"), 3, 0.9).alias("s"), strings.platform(F.lit("SOLiD")).alias("p"),
    ).first()
    assert (row["a"], row["b"], row["g"], row["k"], row["x"], row["t"], row["s"], row["p"]) == (3, 2, 0.5, [1, 6, 11], "ff", 15, True, "SOLID")
    assert abs(row["e"] - math.log(4)) < 1e-9 and abs(row["c"] - 0.8413447) < 1e-6
    assert row["h"] % 2**64 == (0xCBF29CE484222325 * 0x100000001B3 % 2**64) ^ ord("a")


@pytest.mark.parametrize(("library", "flag", "want"), [("fr", 0x40, "+"), ("fr", 0x50, "-"), ("rf", 0x40, "-"), ("rf", 0x50, "+"), ("fr", 0x0, "-"), ("rf", 0x10, "-"), (None, 0x40, "?")])
def test_strand(spark, library, flag, want):
    assert spark.range(1).select(cigar.strand(F.lit(None).cast("string"), F.lit(flag), library).alias("s")).first()["s"] == want


def test_compatible(spark):
    def feats(*x):
        return F.array(*(F.struct(F.lit(c).alias("code"), F.lit(a).alias("left"), F.lit(b).alias("right")) for c, a, b in x))

    t = feats(("S", 1, 10), ("I", 11, 20), ("S", 21, 30), ("I", 31, 40), ("S", 41, 50))
    good = [feats(("S", 3, 8)), feats(("S", 5, 10), ("I", 11, 20), ("S", 21, 25)), feats(("S", 5, 9), ("G", 10, 41), ("S", 42, 45))]
    bad = [feats(("S", 5, 12)), feats(("S", 5, 10), ("I", 11, 40), ("S", 41, 45)), feats(("S", 60, 70))]
    row = spark.range(1).select(*(joins.compatible(r, t).alias(str(i)) for i, r in enumerate([*good, *bad]))).first()
    assert list(row) == [True] * 3 + [False] * 3


def test_em():
    theta = abundance.em(np.array([100, 40, 25.0]), np.array([[0.5, 0.2], [0.3, 0], [0, 0.1]]))
    assert np.allclose(theta, [97.572, 67.428], atol=1e-3) and abs(theta.sum() - 165) < 1e-6
    assert abundance.em(np.array([3.0]), np.array([[0.0]])) is None


@given(st.lists(st.integers(1, 30), min_size=2, max_size=2), st.integers(2, 60), st.integers(1, 10))
def test_effective_length_of_two(segments, fragment, read):
    want = sum(1 <= fragment - i <= segments[1] for i in range(1, segments[0] + 1))
    assert abundance.effective_length(segments, set(), fragment, read) == want


@settings(max_examples=60)
@given(st.integers(3, 7).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 2), st.integers(1, n - 1), st.integers(0, 9)).filter(lambda a: a[0] < a[1]), min_size=1, max_size=9, unique_by=lambda a: a[:2]))))
def test_flow_uses_every_arc(case):
    n, arcs = case
    paths, cost = splice.min_cost_paths(n, arcs)
    price = {(a, b): w for a, b, w in arcs}
    used = [(a, b) for p in paths for a, b in zip(p, p[1:])]
    assert set(used) == set(price) and sum(price[e] for e in used) == cost


def test_bam(spark, tmp_path):
    def block(data):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        size = len(body) + 26
        return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))

    header = b"@SQ\tSN:c1\tLN:100\n"
    head = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)
    body = struct.pack("<iiBBHHHiiii", 0, 9, 3, 60, 0, 1, 0, 4, -1, -1, 0) + b"r1\0" + struct.pack("<I", 4 << 4) + bytes([0x12, 0x48]) + b"\xff" * 4 + b"NHC\x01XSA+"
    path = tmp_path / "x.bam"
    data = head + struct.pack("<i", len(body)) + body
    whole = block(data[:30]) + block(data[30:]) + alignments.END_BLOCK
    path.write_bytes(whole)
    row = alignments.read_bam(spark, str(path), with_seq=True).first()
    assert tuple(row) == ("r1", 0, "c1", 10, 60, "4M", None, 0, "ACGT", "+", None, 1, None)
    assert alignments.header(str(path))[1] == [("c1", 100)]
    for cut in (len(whole) - 28, len(whole) - 5, len(whole) - 40):
        (tmp_path / "cut.bam").write_bytes(whole[:cut])
        with pytest.raises(ValueError, match="end"):
            list(alignments.records(str(tmp_path / "cut.bam")))
    (tmp_path / "short.bam").write_bytes(block(data[:-7]) + alignments.END_BLOCK)
    with pytest.raises(ValueError, match="ends inside a record"):
        list(alignments.records(str(tmp_path / "short.bam")))
    assert alignments.platform("@HD\tVN:1\n@RG\tID:a\tPL:Illumina\n") == "Illumina"


def test_bam_splits(spark, tmp_path):
    """Ranges of blocks of any size give the same records, also where records cross blocks."""

    def block(data):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))

    rng = np.random.default_rng(1)
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for name in (b"c1\0", b"c2\0"):
        data += struct.pack("<i", len(name)) + name + struct.pack("<i", 10**6)
    for i in range(400):
        name, n = f"read{i}".encode() + b"\0", int(rng.integers(4, 150))
        body = struct.pack("<iiBBHHHiiii", i % 2, 10 * i, len(name), 60, 0, 1, 0, n, -1, -1, 0) + name + struct.pack("<I", n << 4) + rng.integers(0, 255, (n + 1) // 2, dtype=np.uint8).tobytes() + b"\xff" * n + b"NHC\x01"
        data += struct.pack("<i", len(body)) + body
    path = tmp_path / "many.bam"
    path.write_bytes(b"".join(block(data[i : i + 701]) for i in range(0, len(data), 701)) + alignments.END_BLOCK)
    want = list(alignments.records(str(path), True))
    assert len(want) == 400 and [w[0] for w in want] == [f"read{i}" for i in range(400)]
    for size in (1, 500, 2000, 9000, 10**9):
        parts = alignments.splits(str(path), size)
        assert [r for a, b in parts for r in alignments.records(str(path), True, a, b)] == want, size
    spark.dataSource.register(alignments.BamSource)
    df = spark.read.format("bam").option("path", str(path)).option("split", "3000").load()
    assert df.rdd.getNumPartitions() > 3 and sorted(r["name"] for r in df.collect()) == sorted(w[0] for w in want)


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">a one\nACGT\nAC\n>b\nGGGG\n")
    assert {(r["name"], r["seq"]) for r in fasta.read(spark, str(path)).collect()} == {("a", "ACGTAC"), ("b", "GGGG")}
    assert [tuple(r) for r in fasta.build_index(spark, str(path)).orderBy("offset").collect()] == [("a", 6, 7, 4, 5), ("b", 4, 18, 4, 5)]


def test_fasta_index_over_blocks(spark, tmp_path):
    """Blocks of a few bytes give the same index as one task; the index file reads back; records load by name."""
    path = tmp_path / "y.fa"
    records = {f"s{k}": "ACGTN" * (7 * k + 3) for k in range(20)}
    path.write_text("".join(f">{n} of {len(q)}\n" + "".join(q[i : i + 60] + "\n" for i in range(0, len(q), 60)) for n, q in records.items()))
    raw = path.read_bytes()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = fasta.build_index(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["name"]: r["length"] for r in rows} == {n: len(q) for n, q in records.items()}
    for r in rows:
        q = records[r["name"]]
        assert raw[r["offset"] : r["offset"] + r["line_bases"]].decode() == q[:60] and r["line_bytes"] == r["line_bases"] + 1
    (tmp_path / "y.fai").write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    assert sorted(map(tuple, fasta.read_index(spark, str(tmp_path / "y.fai")).collect())) == sorted(map(tuple, rows))
    assert fasta.load(spark, str(path), "s3").first()["seq"] == records["s3"]


def test_features_merge(spark):
    kind = "array<struct<code:string,left:bigint,right:bigint,avg_cov:double>>"
    rows = [([("S", 1, 10, 2.0), ("S", 11, 20, 5.0), ("I", 21, 30, 0.0), ("S", 31, 40, 1.0), ("S", 42, 50, 1.0)],), ([],)]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, f"f {kind}").select(intervals.merge_features(F.col("f"))).collect()]
    assert got == [[("S", 1, 20, 2.0), ("I", 21, 30, 0.0), ("S", 31, 40, 1.0), ("S", 42, 50, 1.0)], []]


def test_mate_stream(spark, tmp_path):
    from tessella.streaming.loci import mate_stream

    schema = "name string, id long, ts timestamp"
    rows = spark.range(20).select(F.concat(F.lit("r"), F.col("id") % 10).alias("name"), "id", F.timestamp_seconds(F.col("id") * 60 + 10**6).alias("ts"))
    for k, part in enumerate((rows.where("id < 10"), rows.where("id >= 10"))):
        part.write.parquet(str(tmp_path / str(k)))
    a, b = (spark.readStream.schema(schema).parquet(str(tmp_path / str(k))) for k in (0, 1))
    q = mate_stream(a, b, "name").writeStream.format("memory").queryName("mates").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["first_id"], r["second_id"]) for r in spark.table("mates").collect()) == [(i, i + 10) for i in range(10)]


def test_annotation(spark, tmp_path):
    text = 'c1\tx\texon\t30\t21\t.\t+\t.\tgene_id "g"; transcript_id "t"; gene_name "n";\n#no\nc1\tx\texon\t1\t10\t7\t+\t.\tgene_id "g"; transcript_id "t";\nc1\tx\tother\t1\t10\t.\t+\t.\tgene_id "g";\n'
    path = tmp_path / "x.gtf"
    path.write_text(text)
    parsed = gtf.read(spark, str(path))
    assert [[tuple(e) for e in r["exons"]] for r in gtf.transcripts(parsed).collect()] == [[(1, 10), (21, 30)]]
    assert gtf.read(spark, str(path), strict=True).count() == 1
    with pytest.raises(ValueError, match="chromosome"):
        gtf.load_annotation(parsed, spark.createDataFrame([("c9",)], "ref string"))
    assert gtf.load_annotation(parsed, spark.createDataFrame([("C1",)], "ref string")).first()["chrom"] == "C1"
    gtf.write(gtf.transcripts(parsed), str(tmp_path / "out"), "run")
    with pytest.raises(Exception, match="exist"):
        gtf.write(gtf.transcripts(parsed), str(tmp_path / "out"))


def test_disjoin_tiles_the_union(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 5, 20), (1, 30, 40)], "g int, left long, right long")
    pieces = [(r["left"], r["right"]) for r in ranges.disjoin(df, ["g"]).orderBy("left").collect()]
    assert pieces == [(1, 4), (5, 10), (11, 20), (30, 40)]
    area = ranges.coverage(df, ["g"]).agg(F.sum(F.col("depth") * (F.col("right") - F.col("left") + 1)).alias("a")).first()["a"]
    assert area == 10 + 16 + 11


def test_stream(spark, sf_dir, tmp_path):
    from tessella.streaming.loci import locus_sessions

    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.greatest(F.lit(1), F.col("value").cast("int")).alias("len"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = locus_sessions(stream, ["event_type"]).writeStream.format("memory").queryName("loci").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("loci").agg(F.sum("n_rows").alias("n")).first()["n"]
    assert 0 < rows <= 200


def test_options():
    with pytest.raises(ValueError, match="annotation"):
        Options(no_assembly=True)
    assert Options(annotation="a.gtf", no_assembly=True).fraction == 0
