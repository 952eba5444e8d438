"""Operators whose intermediate rows once grew with pairs, against plain loops."""

import itertools
import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tessella.operators import abundance, introns, joins
from tessella.plans.catalogue import QUERIES
from tessella.sources import gtf


def before_pairs(df):
    """How many shuffles come after the last join of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    top = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    return top[: top.index("Join")].count("Exchange")


def test_overlap_lengths(spark):
    """an owner may have several exons near a fragment, across bins and below zero; pairs aren't shuffled."""
    rng = np.random.default_rng(1)
    frags = [(int(rng.integers(2)), int(x), int(x + rng.integers(0, 45))) for x in rng.choice(np.arange(-150, 400), 40, replace=False)]
    exons = [(int(rng.integers(2)), int(rng.integers(5)), int(x), int(x + rng.integers(0, 60))) for x in rng.integers(-200, 400, 60)]
    got = joins.overlap_lengths(spark.createDataFrame(frags, "locus long, left long, right long"), spark.createDataFrame(exons, "locus long, t long, left long, right long"), ["locus"], "t", 45, "len")
    want = {}
    for (g, a, b), (h, t, c, d) in itertools.product(frags, exons):
        if g == h and min(b, d) >= max(a, c):
            want[g, a, t] = want.get((g, a, t), 0) + min(b, d) - max(a, c) + 1
    rows = got.collect()
    assert {(r["locus"], r["left"], r["t"]): r["len"] for r in rows} == want and len(rows) == len(want)


def test_exonic_fragment_length_shuffles_no_pairs(spark, sf_dir):
    assert before_pairs(QUERIES["exonic_fragment_length"](spark, sf_dir)) == 0


def test_range_medians():
    """medians of ranges over runs, against every position spelled out."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 30):
        ends = np.sort(rng.choice(np.arange(200), 2 * n, replace=False)).reshape(n, 2)
        depth = rng.integers(1, 6, n).astype(float)
        left = rng.integers(-10, 190, 50)
        right = left + rng.integers(0, 40, 50)
        at = np.zeros(400)
        for (a, b), d in zip(ends, depth):
            at[100 + a : 100 + b + 1] = d
        want = [np.median([*at[100 + a : 100 + b], 0.0]) for a, b in zip(left, right)]
        assert introns.range_medians(left, right, ends[:, 0], ends[:, 1], depth).tolist() == want


def test_junction_median_has_no_join(spark, sf_dir):
    assert "Join" not in QUERIES["junction_median"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_em_contained(spark):
    """the bins of fragments by the isoforms that hold them, spelled out; some isoforms are copies of others."""
    rng = np.random.default_rng(3)
    exons = [(g, t, int(x), int(x + rng.integers(5, 60))) for g in range(3) for t, x in zip(range(6), rng.integers(0, 120, 6))]
    exons += [(0, 10, 300, 340), (1, 20, 50, 90), (1, 21, 50, 90), (2, 0, 80, 130)] + [(g, t + 100, a, b) for g, t, a, b in exons if t < 3]
    frags = [(g, int(x), int(x + 4), int(rng.integers(1, 9))) for g in range(3) for x in rng.choice(170, 40, replace=False)]
    length, bins = {}, {}
    for g, t, a, b in exons:
        length[g, t] = length.get((g, t), 0) + b - a + 1
    for g, a, b, n in frags:
        held = tuple(sorted({t for h, t, c, d in exons if h == g and c <= a and b <= d}))
        if held:
            bins[g, held] = bins.get((g, held), 0) + n
    rows = [(g, str(held), n, t, 1.0 / length[g, t]) for (g, held), n in bins.items() for t in held]
    want = abundance.em_abundance(spark.createDataFrame(rows, "locus long, bin string, n long, isoform long, weight double")).collect()
    got = abundance.em_contained(spark.createDataFrame(exons, "locus long, isoform long, left long, right long"), spark.createDataFrame(frags, "locus long, left long, right long, n long")).collect()
    got = {(r["locus"], r["isoform"]): r["theta"] for r in got}
    assert sorted(got) == sorted((r["locus"], r["isoform"]) for r in want)
    assert all(abs(got[r["locus"], r["isoform"]] - r["theta"]) < 1e-9 for r in want)


def test_em_of_ranges():
    """sums over ranges, and EM over bins in ranges, against the same in sparse pairs, for many loci at once."""
    rng = np.random.default_rng(4)
    size, parts = 300, []
    low = rng.integers(0, size, 500)
    last = np.minimum(low + rng.integers(0, 90, 500) ** 2 // 40, size - 1)
    ranges, values, brings = abundance.Ranges(low, last, size), rng.random(size), rng.random(500)
    inside = (low[:, None] <= np.arange(size)) & (np.arange(size) <= last[:, None])
    assert np.allclose(ranges.sums(values), (inside @ values)[ranges.order], rtol=1e-12)
    assert np.allclose(ranges.spread(brings[ranges.order]), brings @ inside, rtol=1e-12)
    at = 0
    for locus in range(60):  # some of few bins, so that they are done long before others
        n, m = int(rng.integers(1, 4 if locus % 2 else 40)), int(rng.integers(1, 12))
        for _ in range(m):
            cuts = np.sort(rng.choice(n + 1, 2 * int(rng.integers(1, (n + 1) // 2 + 1)), replace=False)).reshape(-1, 2)
            parts.append((locus, cuts + at, 10.0 ** -rng.integers(1, 7)))
        at += n
    bin_locus = np.zeros(at, int)
    for locus, cuts, _ in parts:
        bin_locus[cuts.min() : cuts.max()] = locus
    bin_locus = np.maximum.accumulate(bin_locus)
    counts, isoform_locus, copies = rng.integers(0, 50, at).astype(float), np.array([x[0] for x in parts]), rng.integers(1, 4, len(parts))
    counts[bin_locus == 7] = 0
    weights = np.array([x[2] for x in parts])
    isoform_of, low, high = (np.concatenate(c) for c in zip(*((np.full(len(c), k), c[:, 0], c[:, 1]) for k, (_, c, _) in enumerate(parts))))
    pairs = [(b, i) for i, a, e in zip(isoform_of, low, high) for b in range(a, e)]
    bin_of, whose = np.array(pairs).T
    want, _ = abundance.em_many(counts, bin_of, whose, weights[whose], bin_locus, isoform_locus, copies)
    got = abundance.em_ranges(counts, low, high - 1, isoform_of, weights, bin_locus, isoform_locus, copies)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_em_contained_nested(spark):
    """fragments of any length inside each other, and exons of an isoform that overlap, meet or are equal."""
    rng = np.random.default_rng(5)
    exons = [(g, int(rng.integers(6)), x := int(rng.integers(0, 150)), x + int(rng.integers(1, 70))) for g in range(4) for _ in range(20)] + [(0, 1, 20, 60), (0, 1, 61, 90), (5, 0, 1, 9)]
    frags = sorted({(g, x := int(rng.integers(0, 170)), x + int(rng.integers(0, 50))) for g in range(4) for _ in range(90)} | {(6, 3, 4)})
    frags = [(*f, int(rng.integers(1, 9))) for f in frags]
    length, bins = {}, {}
    for g, t, a, b in exons:
        length[g, t] = length.get((g, t), 0) + b - a + 1
    for g, a, b, n in frags:
        held = tuple(sorted({t for h, t, c, d in exons if h == g and c <= a and b <= d}))
        if held:
            bins[g, held] = bins.get((g, held), 0) + n
    rows = [(g, str(held), n, t, 1.0 / length[g, t]) for (g, held), n in bins.items() for t in held]
    want = abundance.em_abundance(spark.createDataFrame(rows, "locus long, bin string, n long, isoform long, weight double")).collect()
    got = abundance.em_contained(spark.createDataFrame(exons, "locus long, isoform long, left long, right long"), spark.createDataFrame(frags, "locus long, left long, right long, n long")).collect()
    got = {(r["locus"], r["isoform"]): r["theta"] for r in got}
    assert sorted(got) == sorted((r["locus"], r["isoform"]) for r in want)
    assert all(abs(got[r["locus"], r["isoform"]] - r["theta"]) < 1e-9 for r in want)


def test_contained_bins_makes_no_pairs():
    """4,000 exons that hold about a thousand fragments each take room for exons and fragments, not for four million pairs."""
    rng = np.random.default_rng(6)
    left = np.sort(rng.integers(0, 3000, 4000))
    exons = pd.DataFrame({"locus": 1, "isoform": np.arange(4000), "left": left, "right": left + rng.integers(700, 1300, 4000), "n": -1})
    frags = pd.DataFrame({"locus": 1, "isoform": -1, "left": np.arange(4000), "right": np.arange(4000) + 4, "n": 2})
    tracemalloc.start()
    found = abundance.contained_bins(pd.concat([exons, frags], ignore_index=True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found["names"]) == 4000 and most < 16e6


def test_em_abundance_has_no_join(spark, sf_dir):
    assert "Join" not in QUERIES["em_abundance"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_annotation_is_split_once(spark):
    """a line is split once, not for each look at a field."""
    plan = gtf.parse(spark.createDataFrame([("chr1\tx\texon\t1\t9\t.\t+\t.\tgene_id \"a\";",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_genes_of_many_exons(spark):
    """a gene's exons aren't compared each with each, and are the distinct ones of its transcripts."""
    row = "chrom string, strand string, gene_id string, transcript_id string, left long, right long, kind string, parent string, gene_name string"
    lines = [("c", "+", g, f"{g}{k % 40}" if g else None, k * 7 % 300, k * 7 % 300 + k % 5, "exon", None, "n") for g in ("a", "b", None) for k in range(900)]
    own = gtf.transcripts(spark.createDataFrame(lines, row))
    found = gtf.genes(own)
    assert "array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["gene_id"]: r for r in found.collect()}
    for g in ("a", "b", None):
        want = sorted({x[4:6] for x in lines if x[2] == g})
        assert [tuple(e) for e in got[g]["exons"]] == want and (got[g]["left"], got[g]["right"]) == (want[0][0], max(r for _, r in want))
        assert got[g]["transcripts"] == sorted({x[3] for x in lines if x[2] == g and x[3]}) and got[g]["gene_name"] == "n"


def test_load_annotation_looks_at_lines(spark, monkeypatch):
    """whether any reference is known is asked of lines; transcripts are made once and only by the result."""
    lines = spark.createDataFrame([("C1", "+", "g", "t", 1, 9, "exon", None, "n")], "chrom string, strand string, gene_id string, transcript_id string, left long, right long, kind string, parent string, gene_name string")
    jobs = []
    monkeypatch.setattr(gtf, "transcripts", lambda parsed, f=gtf.transcripts: jobs.append(f(parsed)) or jobs[-1])
    out = gtf.load_annotation(lines, spark.createDataFrame([("c1",)], "ref string"))
    assert len(jobs) == 1 and not out.isEmpty()
    jobs.clear()
    with pytest.raises(ValueError):
        gtf.load_annotation(lines, spark.createDataFrame([("c2",)], "ref string"))
    assert not jobs


def test_op8_removes_packed_sequences(spark, sf_dir, monkeypatch):
    """Only shards and index stay once they are written, and the result is read from them."""
    from tessella.llm import materialise, queries

    folders = []
    monkeypatch.setattr(materialise, "shared_folder", lambda s, f=materialise.shared_folder: folders.append(f(s)) or folders[-1])
    out = queries.op8_training_order(spark, sf_dir)
    there = [f for f in folders if os.path.exists(f.removeprefix("file:"))]
    assert len(folders) > 1 and len(there) == 1 and sorted(os.listdir(there[0].removeprefix("file:"))) == ["index", "shards"]
    assert sorted(r["slot"] for r in out.select("slot").collect()) == list(range(out.count()))
