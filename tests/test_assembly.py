"""Segments, splice graphs, fragments, abundance and whole analyses, against hand-made cases and exhaustive search."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import abundance, cluster, fragments, introns, numbering, segments, splice
from tessella.plans import pipeline
from tessella.plans.catalogue import QUERIES
from tessella.session import Options
from tessella.sources import context, gtf

FEATURES = "array<struct<code:string,left:bigint,right:bigint>>"


def test_gaps_are_closed_by_distance():
    assert segments.fill_gaps([(1, 10), (39, 50)], []) == [(1, 50)] and segments.fill_gaps([(1, 10), (40, 50)], []) == [(1, 10), (40, 50)]
    assert segments.fill_gaps([(1, 10), (19, 50)], [(5, 60)]) == [(1, 50)] and segments.fill_gaps([(1, 10), (20, 50)], [(5, 60)]) == [(1, 10), (20, 50)]
    assert segments.fill_gaps([(1, 10), (15, 50)], [(11, 14)]) == [(1, 10), (15, 50)]


def test_runs_without_a_junction_are_no_locus():
    assert segments.of_locus([(1, 10, 3.0), (100, 120, 3.0)], {}, 0.01) == ([], [])
    assert segments.of_locus([(1, 10, 3.0)], {}, 0.01)[0] == [(1, 10, pytest.approx(2.7))]


def test_thin_and_loose_segments_go():
    runs = [(1, 100, 50.0), (101, 200, 0.1), (201, 300, 50.0), (400, 420, 9.0)]
    found, kept = segments.of_locus(runs, {(101, 200): 40.0}, 0.01)
    assert [s[:2] for s in found] == [(1, 100), (201, 300)] and kept == [(101, 200)]


def test_constant_depth_with_one_junction():
    """A junction that cuts a run of constant depth leaves the way straight on the cheapest."""
    parts = [(1, 100), (101, 200), (201, 300)]
    arcs = splice.arcs_of(parts, {(101, 200): 3.0}, {100: 10.0, 200: 10.0})
    assert sorted(arcs) == [(0, 1, 0), (0, 2, 7), (1, 2, 0)]


def brute_cost(nodes, arcs, required):
    """The least cost of paths that together use every required arc, by search over sets of paths."""
    out = {}
    for a, b, w in arcs:
        out.setdefault(a, []).append((b, w))
    has_in, has_out = {b for _, b, _ in arcs}, set(out)
    paths = []

    def walk(v, used, cost):
        if v not in has_out:
            paths.append((frozenset(used), cost))
            return
        for k, (a, b, w) in enumerate(arcs):
            if a == v:
                walk(b, [*used, k], cost + w)

    for v in has_out - has_in:
        walk(v, [], 0)
    need = frozenset(k for k, r in enumerate(required) if r)
    best = {frozenset(): 0}
    for _ in range(len(need)):
        for held, c in list(best.items()):
            for used, w in paths:
                now = held | (used & need)
                if c + w < best.get(now, math.inf):
                    best[now] = c + w
    return best[need]


@settings(max_examples=80, deadline=None)
@given(st.integers(3, 6).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 2), st.integers(1, n - 1), st.integers(0, 9)).filter(lambda a: a[0] < a[1]), min_size=1, max_size=7, unique_by=lambda a: a[:2]), st.lists(st.booleans(), min_size=7, max_size=7))))
def test_flow_is_optimal(case):
    n, arcs, flags = case
    required = flags[: len(arcs)]
    paths, cost = splice.min_cost_paths(n, arcs, required)
    assert cost == brute_cost(n, arcs, required)
    price = {(a, b): w for a, b, w in arcs}
    used = [(a, b) for p in paths for a, b in zip(p, p[1:])]
    assert {(a, b) for (a, b, _), r in zip(arcs, required) if r} <= set(used)


def test_read_paths_phase_distant_choices():
    """Two starts and two ends around a shared segment: reads over all three tell which belong together."""
    arcs = [(0, 2, 5), (1, 2, 5), (2, 3, 5), (2, 4, 5)]
    more, required, inner = splice.constrained(arcs, [[0, 2, 4], [1, 2, 3], [1, 2, 3], [0, 2]])
    assert more[4:] == [(0, 4, 10), (1, 3, 10)] and required == [False] * 4 + [True] * 2 and inner == {4: [2], 5: [2]}
    paths, _ = splice.min_cost_paths(5, more, required, inner)
    assert sorted(paths) == [[0, 2, 4], [1, 2, 3]]
    # A hop that is no arc is filled with the fewest arcs; a path that doesn't branch says nothing.
    line = [(0, 1, 1), (1, 2, 1), (2, 3, 1)]
    assert splice.constrained(line, [[0, 1, 2], [0, 2, 3]]) == (line, [True] * 3, {})
    wide = [(0, 2, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1), (3, 5, 1), (4, 5, 1)]
    more, _, inner = splice.constrained(wide, [[0, 2, 5]])
    assert more[6] == (0, 5, 3) and inner[6] == [2, 3]


def feats(text):
    return [(p[0], *map(int, p[1:].split("-"))) for p in text.split()]


@pytest.mark.parametrize(
    ("first", "second", "want"),
    [
        ("S1-10", "S20-30", "S1-10 G11-19 S20-30"),
        ("S1-10", "S5-30", "S1-30"),
        ("S1-10 I11-50 S51-60", "S5-10 I11-50 S51-70", "S1-10 I11-50 S51-70"),
        ("S1-10 I11-50 S51-60", "S5-10 I11-40 S41-70", None),
        ("S1-10", "S11-30", None),
    ],
)
def test_mates(spark, first, second, want):
    df = spark.createDataFrame([(feats(first), feats(second))], f"a {FEATURES}, b {FEATURES}")
    got = df.select(fragments.joined_features(F.col("a"), F.col("b")).alias("f")).first()["f"]
    assert (None if got is None else [tuple(x) for x in got]) == (None if want is None else feats(want))


def test_before_starts_and_numbers(spark):
    df = spark.createDataFrame([("a", i, i * 400_000) for i in range(1, 12)], "ref string, id long, left long")
    starts = spark.createDataFrame([("a", 800_000), ("a", 2_500_000)], "ref string, left long")
    rows = {r["id"]: r["after"] for r in cluster.before_starts(df, starts, ["ref"], "id").collect()}
    assert rows == {i: (i * 400_000 >= 800_000) + (i * 400_000 >= 2_500_000) for i in range(1, 12)}
    got = {r["id"]: r["n"] for r in numbering.numbered(df.withColumn("o", -F.col("id")), ["o"], "n").collect()}
    assert got == {i: 12 - i for i in range(1, 12)}
    assert numbering.numbered(df.limit(0), ["id"], "n").count() == 0


@given(st.lists(st.integers(1, 12), min_size=1, max_size=5), st.integers(1, 40), st.integers(1, 8), st.integers(0, 31))
def test_effective_length_by_enumeration(sizes, fragment, read, hidden):
    implicit = {k for k in range(1, len(sizes) - 1) if hidden >> k & 1}
    ends = list(itertools.accumulate(sizes))
    spans = [(b - n, b) for n, b in zip(sizes, ends)]
    n = 0
    for start in range(ends[-1] - fragment + 1):
        stop = start + fragment
        if start >= spans[0][1] or stop <= spans[-1][0]:
            continue
        reads = [(start, start + read), (stop - read, stop)]
        hit = {k for k, (a, b) in enumerate(spans) if any(x < b and a < y for x, y in reads)} | {0, len(sizes) - 1}
        n += hit == set(range(len(sizes))) - implicit
    if len(sizes) == 1:
        assert abundance.effective_length(sizes, set(), fragment, read) == max(0, sizes[0] - fragment + 1)
    else:
        assert abundance.effective_length(sizes, implicit, fragment, read) == n


def brute_em(counts, weights):
    counts = [math.floor(c) for c in counts]
    m = len(weights[0])
    theta = [sum(counts) / m] * m
    kept = [(c, list(w)) for c, w in zip(counts, weights) if any(x > 1e-5 for x in w)]
    for _ in range(1000):
        new = [0.0] * m
        for c, w in kept:
            total = sum(x * t for x, t in zip(w, theta))
            for k in range(m):
                new[k] += c * w[k] * theta[k] / total
        sums = [sum(w[k] for _, w in kept) for k in range(m)]
        kept = [(c, [x / s if s else 0.0 for x, s in zip(w, sums)]) for c, w in kept]
        if math.sqrt(sum((a - b) ** 2 for a, b in zip(new, theta))) < 1e-2:
            return theta
        theta = new
    return theta


def test_em_abundance_brute_force(spark, sf_dir):
    """Many loci at once, against a plain loop over each; bins of the catalogue's query."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for locus in range(40):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        w = rng.random((n, m)).round(2)
        w[:, 0] = np.maximum(w[:, 0], 0.1)
        c = rng.integers(0, 60, n) + rng.random(n)
        rows += [(locus, str(b), float(c[b]), i, float(w[b, i])) for b in range(n) for i in range(m)]
        want |= {(locus, i): t for i, t in enumerate(brute_em(c, w.tolist()))}
    df = spark.createDataFrame(rows, "locus long, bin string, n double, isoform long, weight double").repartition(5)
    got = {(r["locus"], r["isoform"]): r["theta"] for r in abundance.em_abundance(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert QUERIES["em_abundance"](spark, sf_dir).where("theta < 0 or theta is null").count() == 0


def test_flow_assembly_covers_the_junctions(spark, sf_dir):
    """The query's transcripts are paths of segments of their locus that use every junction of it, unless too short."""
    from tessella.plans.catalogue_loci import _segments

    made, parts = QUERIES["flow_assembly"](spark, sf_dir).collect(), _segments(spark, sf_dir).collect()
    assert made
    for r in made:
        own = {(p["left"], p["right"]) for p in parts if p["locus"] == r["locus"] and p["kind"] == "segment"}
        jumps = {(p["left"], p["right"]) for p in parts if p["locus"] == r["locus"] and p["kind"] == "junction"}
        exons = [tuple(e) for e in r["exons"]]
        assert all((a[1] + 1, b[0] - 1) in jumps for a, b in zip(exons, exons[1:]))
        assert all(any(a == left for a, _ in own) and any(b == right for _, b in own) for left, right in exons)


# --- whole analyses

EXONS = {"A": [(1001, 1300), (1501, 1700), (2001, 2400)], "B": [(1001, 1300), (2001, 2400)]}


def simulated(seed=3, n=600, share=0.75, read=60):
    """SAM lines of mates from two isoforms: A has the middle exon, B skips it."""
    rng = np.random.default_rng(seed)
    lines = []

    def place(exons, offset, size):
        """Position and CIGAR of ``size`` bases from an offset in the transcript."""
        cigar, pos = [], None
        for k, (a, b) in enumerate(exons):
            length = b - a + 1
            if offset >= length:
                offset -= length
                continue
            take = min(size, length - offset)
            pos = pos or a + offset
            cigar.append(f"{take}M")
            size, offset = size - take, 0
            if not size:
                return pos, "".join(cigar)
            cigar.append(f"{exons[k + 1][0] - b - 1}N")
        raise AssertionError

    for i in range(n):
        exons = EXONS["A" if rng.random() < share else "B"]
        length = sum(b - a + 1 for a, b in exons)
        size = int(np.clip(rng.normal(200, 20), 130, 300))
        start = int(rng.integers(0, length - size + 1))
        (p, c), (q, d) = place(exons, start, read), place(exons, start + size - read, read)
        tag = "\tXS:A:+" if "N" in c + d else ""
        lines.append(f"f{i}\t99\tchr1\t{p}\t60\t{c}\t=\t{q}\t{size}\t*\t*{tag if 'N' in c else ''}\tNH:i:1")
        lines.append(f"f{i}\t147\tchr1\t{q}\t60\t{d}\t=\t{p}\t-{size}\t*\t*{tag if 'N' in d else ''}\tNH:i:1")
    return lines


@pytest.fixture(scope="module")
def reads(spark):
    from tessella.sources import alignments

    return alignments.parse_sam(spark.createDataFrame([(x,) for x in simulated()], "value string").repartition(3)).persist()


@pytest.fixture(scope="module")
def models(spark):
    rows = [("chr1", "+", "gene", f"t{k}", "name", v) for k, v in EXONS.items()]
    return spark.createDataFrame(rows, "chrom string, strand string, gene_id string, transcript_id string, gene_name string, exons array<struct<left:bigint,right:bigint>>")


def test_de_novo(reads):
    rows = pipeline.run(reads, Options()).collect()
    inner = {tuple((a["right"], b["left"]) for a, b in zip(r["exons"], r["exons"][1:])): r for r in rows}
    assert set(inner) == {((1300, 1501), (1700, 2001)), ((1300, 2001),)}
    assert {r["strand"] for r in rows} == {"+"} and {r["gene_id"] for r in rows} == {"sample.1"}
    frac = {len(k): float(r["Frac"]) for k, r in inner.items()}
    assert abs(frac[2] - 0.75) < 0.12 and abs(sum(frac.values()) - 1) < 1e-5
    assert abs(sum(float(r["TPM"]) for r in rows) - 1e6) < 1


def test_quantify_given(reads, models):
    made = pipeline.analyse(reads, Options(annotation="x.gtf", no_assembly=True), models)
    rows = {r["transcript_id"]: r for r in made.transcripts.collect()}
    assert abs(float(rows["tA"]["Frac"]) - 0.75) < 0.08
    table = made.context.collect()
    # Mates that contradict each other or that touch without a gap are no fragment; all others fit a transcript.
    total = table[0]["sample_frag_count"]
    assert 500 < total <= 600 and {r["sample_frag_count"] for r in table} == {total}
    assert sum(r["path_count"] for r in table) == table[0]["gene_frag_count"] <= total
    middle = [r for r in table if "[1501-1700]" in r["path_symbol"]]
    assert middle and all(r["transcripts"] == "tA,tB" and r["conditional_probabilities"].split(",")[1] == "0.000000000000" for r in middle)
    assert all(float(p) > 0 for r in middle for p in r["conditional_probabilities"].split(",")[:1])


def test_guided(spark, reads, models, tmp_path):
    """Given transcripts guide what reads support; rows name the gene, and files are written where they are named."""
    annotation = tmp_path / "a.gtf"
    annotation.write_text("\n".join(r["line"] for r in gtf.lines(models).collect()) + "\n")
    genome = spark.createDataFrame([("chr1", "ACGT" * 1000)], "name string, seq string")
    options = Options(annotation=str(annotation), output=str(tmp_path / "out"), context=str(tmp_path / "ctx"), log=str(tmp_path / "log"), verbose=True)
    rows = pipeline.run(reads, options, genome=genome).collect()
    assert {r["ref_gene_id"] for r in rows} == {"gene"} and len(rows) == 2
    lines = [r["value"] for r in spark.read.text(options.output).collect()]
    assert sum("\ttranscript\t" in x and 'ref_gene_id "gene"' in x and "FPKM" in x for x in lines) == 2
    table = spark.read.option("header", True).option("sep", "\t").csv(options.context)
    assert len(table.columns) == 16 and {float(r["path_gc_content"]) for r in table.collect()} and all(abs(float(r["path_gc_content"]) - 0.5) < 0.05 for r in table.collect())
    assert sum("raw read count" in r["value"] for r in spark.read.text(options.log).collect()) == 2


def test_options_have_an_effect(reads):
    strict = pipeline.run(reads, Options(min_junction_reads=10_000)).collect()
    assert all(len(r["exons"]) == 1 for r in strict)
    assert pipeline.run(reads, Options(min_transcript_depth=1e6)).count() == 0
    assert pipeline.run(reads, Options(min_locus_reads=10_000)).count() == 0
    assert pipeline.run(reads, Options(no_quant=True)).columns == ["chrom", "strand", "gene_id", "transcript_id", "exons"]
    anchors = pipeline.run(reads, Options(small_anchor=61)).collect()
    assert all(len(r["exons"]) == 1 for r in anchors)
    own = {r["transcript_id"]: float(r["FPKM"]) for r in pipeline.run(reads, Options(insert_size=(400.0, 30.0))).collect()}
    usual = {r["transcript_id"]: float(r["FPKM"]) for r in pipeline.run(reads, Options()).collect()}
    assert own.keys() == usual.keys() and any(abs(own[k] - usual[k]) > 1 for k in own)
    with pytest.warns(UserWarning):
        Options(min_mapping_quality=10)


def test_loci_of_an_annotation(spark):
    rows = [("c", "+", "g", "t1", [(1, 10)]), ("c", "+", "g", "t2", [(50, 60)]), ("c", "+", None, "u1", [(100, 120)]), ("c", "+", None, "u2", [(110, 130)]), ("c", "-", None, "u3", [(115, 118)])]
    df = spark.createDataFrame(rows, "chrom string, strand string, gene_id string, transcript_id string, exons array<struct<left:bigint,right:bigint>>")
    loci = {}
    for r in pipeline.reference_loci(df).collect():
        loci.setdefault((r["locus"], r["locus_left"], r["locus_right"]), set()).add(r["transcript_id"])
    assert sorted((k[1:], sorted(v)) for k, v in loci.items()) == [((1, 60), ["t1", "t2"]), ((100, 130), ["u1", "u2"]), ((115, 118), ["u3"])]


def test_guided_clusters_stop_at_a_locus(spark):
    hits = spark.createDataFrame([(i, f"r{i}", "c", p, p + 30, "+", 1.0, None, [("S", p, p + 30)]) for i, p in enumerate([10, 60, 95, 140])], f"id long, name string, ref string, left long, right long, strand string, mass double, mate_left long, features {FEATURES}")
    loci = spark.createDataFrame([("c", 7, 100, 105)], "ref string, locus long, left long, right long")
    rows = {r["id"]: r["locus"] for r in pipeline.with_loci(hits, Options(), loci).collect()}
    assert rows[2] == 7 and rows[0] == rows[1] and rows[3] not in (7, rows[0])


def test_context_sequence(spark):
    rows = spark.createDataFrame([("GGGGCCCCGGGGCCCCGGGGA",), ("ACGTAC",)], "seq string")
    got = context.with_sequence(rows).collect()
    assert [r["gc_stretch_0.9_20"] for r in got] == [1, 0] and abs(got[0]["path_gc_content"] - 20 / 21) < 1e-9


def test_junction_filters(spark):
    df = spark.createDataFrame([(1, 100, 200, 100), (1, 150, 250, 3), (1, 110, 190, 2), (1, 900, 950, 1)], "locus long, left long, right long, n_reads long")
    kept = {(r["left"], r["right"]) for r in introns.drop_dominated(df, ["locus"], 0.01).collect()}
    assert kept == {(100, 200), (110, 190), (900, 950)}  # 3 of 103 is less than ten hundredths, 2 of 102 no less than one
    every = {(r["left"], r["right"]) for r in introns.drop_dominated(df, ["locus"], 0.2).collect()}
    assert every == {(100, 200), (900, 950)}
    s = spark.range(1).select(introns.anchored_enough(F.lit(10.0), F.lit(9.0), 10, 100, 0.05).alias("a"), introns.anchored_enough(F.lit(10.0), F.lit(2.0), 10, 100, 0.05).alias("b"), introns.anchored_enough(F.lit(10.0), F.lit(10.0), 10, 100, 0.0).alias("c")).first()
    assert tuple(s) == (False, True, False)
