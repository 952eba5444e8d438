"""Whole analyses: de novo assembly, guided assembly, and quantification of given transcripts.

All three are one declarative plan up to the grouped solvers: filter, cluster, pair mates, split by strand,
coverage and junctions, filters, segments, flow, compatibility, bins, expectation-maximisation, normalisation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import cigar
from tessella.operators import abundance, cluster, fragments, introns, joins, numbering, ranges, segments, splice
from tessella.session import Options, settled
from tessella.sources import context as contexts
from tessella.sources import gtf

#: Least mean depth of a locus; reads longer than LONG_READ of more than LONG_LENGTHS lengths are a long-read run.
LEAST_DEPTH, LONG_READ, LONG_LENGTHS = 1.0, 1000, 10


def valid_hits(reads: DataFrame, options: Options) -> DataFrame:
    """Kept reads: id, name, ref, left, right, strand, mass, features, mate_left, read_len.  Equal rows are reads of their own."""
    ops = cigar.parse(F.col("cigar"))
    rows = reads.where(cigar.mapped(F.col("flag"), F.col("ref"))).withColumn("ops", ops)
    rows = rows.where(cigar.valid_cigar(F.col("ops"), options.min_intron, options.max_intron) & cigar.unique_hit(F.col("flag"), F.col("nh"), options.allow_multimapped))
    if options.enforce_mapping_quality:
        rows = rows.where(F.col("mapq") >= options.min_mapping_quality)
    single = F.col("mate_ref").isNull() | (F.col("mate_left") == 0)
    return settled(
        rows.select(
            F.monotonically_increasing_id().alias("id"),
            "name",
            "ref",
            "left",
            (F.col("left") + cigar.reference_span(F.col("ops")) - 1).alias("right"),
            cigar.strand(F.col("xs"), F.col("flag"), options.library).alias("strand"),
            cigar.mass(single, F.col("nh")).alias("mass"),
            F.when(~single & (F.col("mate_ref") == F.col("ref")), F.col("mate_left")).otherwise(F.when(~single, F.lit(-1).cast("long"))).alias("mate_left"),
            cigar.features(F.col("left"), F.col("ops")).alias("features"),
            cigar.read_length(F.col("ops")).alias("read_len"),
            (F.col("mapq") < options.min_mapping_quality).alias("poor"),
        )
    )


def inspected(hits: DataFrame, options: Options) -> tuple[int, bool]:
    """The most frequent length of the first ``inspected_reads`` reads (the least of equals), and whether they are long reads."""
    counts = hits.limit(options.inspected_reads).groupBy("read_len").agg(F.count("*").alias("n"))
    row = counts.agg(F.min_by("read_len", F.struct(-F.col("n"), "read_len")).alias("mode"), F.count_if(F.col("read_len") > LONG_READ).alias("long")).first()
    return row["mode"] or 1, row["long"] > LONG_LENGTHS


def with_loci(hits: DataFrame, options: Options, loci: DataFrame | None = None) -> DataFrame:
    """Hits by cluster, as locus; a mate's position within the longest intron widens its hit.

    loci (ref, locus, left, right): hits that touch one are in the first of them by position; others form
    clusters of their own, which end where the next of these loci starts.
    """
    reach = F.greatest("right", F.when(F.abs(F.col("mate_left") - F.col("left")) < options.max_intron, F.col("mate_left")))
    rows = hits.withColumn("reach", F.coalesce(reach, F.col("right")))
    if loci is None:
        found = cluster.gap_cluster(rows, ["ref"], "id", right="reach", gap=options.gap)
        return found.withColumn("locus", F.xxhash64("ref", "cluster")).drop("reach", "cluster")
    held = joins.first_locus(hits.withColumn("strand", F.lit("?")), loci.withColumn("strand", F.lit("?")), ["ref"], bin_width=100_000)
    free = cluster.before_starts(rows.join(held, "id", "left_anti"), loci, ["ref"], "id", out="after")
    free = cluster.gap_cluster(free, ["ref", "after"], "id", right="reach", gap=options.gap)
    free = free.withColumn("locus", F.xxhash64("ref", "after", "cluster")).drop("reach", "cluster", "after")
    return hits.join(held, "id").unionByName(free)


def fragments_of(hits: DataFrame) -> DataFrame:
    """Distinct fragments by locus: mates paired, outliers by span left out, equal ones collapsed."""
    both = fragments.fragments(hits, ["ref", "locus"])
    return settled(fragments.collapse(fragments.without_outliers(both, ["ref", "locus"]), ["ref", "locus"]))


def reference_loci(annotation: DataFrame) -> DataFrame:
    """Transcripts with their locus and its ends: by gene, and where that is missing by overlap on a strand."""
    ends = annotation.withColumn("left", F.col("exons")[0]["left"]).withColumn("right", F.element_at("exons", -1)["right"])
    named = ends.where("gene_id is not null").withColumn("locus", F.xxhash64("chrom", "gene_id"))
    loose = cluster.gap_cluster(ends.where("gene_id is null"), ["chrom", "strand"], "transcript_id", gap=0)
    loose = loose.withColumn("gene_id", F.concat_ws(".", "chrom", "strand", "cluster")).withColumn("locus", F.xxhash64("chrom", "gene_id")).drop("cluster")
    both = named.unionByName(loose)
    spans = both.groupBy("locus").agg(F.min("left").alias("locus_left"), F.max("right").alias("locus_right"), F.min("strand").alias("locus_strand"))
    return both.drop("left", "right").join(spans, "locus")


def pieces(frags: DataFrame, options: Options, given: DataFrame | None = None) -> DataFrame:
    """Fragments by the part that is assembled: part, locus, ref, run_strand, id, mass, features, given, low, high.

    Loci of too few fragments are left out.  A locus of given transcripts is one part: they are
    fragments of mass 1 themselves (``given``), and reads of the other strand go.  Others are split by strand.
    low and high bound what counts for coverage.
    """
    busy = frags.groupBy("locus").agg(F.count("*").alias("n")).where(F.col("n") >= options.min_locus_reads)
    kept = frags.join(busy.select("locus"), "locus", "left_semi")
    cols = ["part", "locus", "ref", "run_strand", "id", "mass", "features", "given", "low", "high"]
    free = kept if given is None else kept.join(given.select("locus").distinct(), "locus", "left_anti")
    split = fragments.strand_runs(free, ["ref", "locus"]).withColumn("part", F.xxhash64("locus", "run", "part"))
    out = split.withColumn("given", F.lit(False)).withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(1 << 40).cast("long")).select(cols)
    if given is None:
        return out
    spans = given.select("locus", F.col("locus_left").alias("low"), F.col("locus_right").alias("high"), F.col("locus_strand").alias("run_strand")).distinct()
    own = kept.join(spans, "locus").where((F.col("strand") == "?") | (F.col("strand") == F.col("run_strand")))
    own = own.withColumn("part", F.col("locus")).withColumn("given", F.lit(False)).select(cols)
    models = given.join(busy.select("locus"), "locus", "left_semi").select(
        F.col("locus").alias("part"), "locus", F.col("chrom").alias("ref"), F.col("locus_strand").alias("run_strand"), F.xxhash64("transcript_id").alias("id"), F.lit(1.0).alias("mass"),
        _features(F.col("exons")).alias("features"), F.lit(True).alias("given"), F.col("locus_left").alias("low"), F.col("locus_right").alias("high"),
    )
    return out.unionByName(own).unionByName(models)


def filtered_junctions(counted: DataFrame, runs: DataFrame, options: Options, read_length: int) -> DataFrame:
    """Junctions (locus, left, right, n_reads, n_small) that pass every filter, in the order of the filters."""
    left = settled(introns.drop_dominated(counted, ["locus"], options.min_fraction))
    left = left.where(introns.supported(F.col("n_reads"), F.col("left"), F.col("right"), least=options.min_junction_reads))
    over = ranges.coverage(left.withColumn("n", F.col("n_reads").cast("decimal(18,6)")), ["locus"], weight="n")
    left = left.where(introns.anchored_enough(F.col("n_reads"), F.col("n_small"), options.small_anchor, read_length, options.anchor_alpha))
    depths = introns.inner_depth(introns.inner_depth(left, over, ["locus"], "intron_sum"), runs, ["locus"], "exon_sum")
    size = F.col("right") - F.col("left")
    deep = introns.deep_enough(depths.withColumn("intron_depth", F.col("intron_sum") / (size + 1)).withColumn("exon_depth", F.col("exon_sum") / size), "intron_depth", "exon_depth", options.min_fraction)
    return deep.select("locus", "left", "right", "n_reads")


def assemble(frags: DataFrame, options: Options, read_length: int, given: DataFrame | None = None) -> DataFrame:
    """Transcripts: part, locus, ref, strand, transcript, exons."""
    own = settled(pieces(frags, options, given))
    parts = settled(fragments.anchored(own.drop("locus").withColumnRenamed("part", "locus"), ["locus", "id", "mass", "given", "low", "high"]))
    read = parts.where("not given")
    blocks = read.where("code = 'S' and left <= high and right >= low").withColumn("left", F.greatest("left", "low")).withColumn("right", F.least("right", "high"))
    runs = settled(ranges.coverage(blocks.withColumn("mass", F.col("mass").cast("decimal(18,6)")), ["locus"], weight="mass"))
    size = F.col("right") - F.col("left") + 1
    deep = runs.groupBy("locus").agg((F.sum(F.col("depth") * size) / F.sum(size)).alias("d")).where(F.col("d") >= LEAST_DEPTH).select("locus")
    runs = runs.join(deep, "locus", "left_semi")
    jumps = read.where("code = 'I' and left >= low and right <= high").join(deep, "locus", "left_semi").withColumn("small", F.col("anchor") < options.small_anchor)
    counted = settled(introns.junction_counts(jumps, ["locus"], small="small"))
    found = settled(segments.parts(runs, filtered_junctions(counted, runs, options, read_length), options.min_fraction))
    cut = found.where("kind = 'segment'")
    spans = parts.where("code = 'S'").join(cut.select("locus").distinct(), "locus", "left_semi")
    made = splice.assemble(found, splice.joints(spans, cut), splice.read_paths(spans, cut), options.min_transcript_length, options.min_transcript_depth)
    names = own.select(F.col("part"), F.col("locus").alias("of"), "ref", F.col("run_strand").alias("strand")).distinct()
    return settled(made.withColumnRenamed("locus", "part").join(names, "part").withColumnRenamed("of", "locus").drop("cost"))


@dataclass
class Bins:
    """What quantification works on: fragments that fit (locus, id, transcript, touched, mass), bins with their
    weights, and the total of mapped reads (one row)."""

    fits: DataFrame
    bins: DataFrame
    total: DataFrame


def assigned(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Fragments of the first locus of transcripts that each hit overlaps on an agreeing strand."""
    spans = transcripts.groupBy("ref", "locus").agg(F.min(F.col("exons")[0]["left"]).alias("left"), F.max(F.element_at("exons", -1)["right"]).alias("right"), F.min("strand").alias("strand"))
    held = joins.first_locus(hits, spans, ["ref"], bin_width=100_000)
    return fragments_of(hits.join(held, "id"))


def exon_bins(frags: DataFrame, transcripts: DataFrame, options: Options, read_length: int, long_reads: bool, total: DataFrame | None = None) -> Bins:
    """Fits, bins and weights of transcripts: locus, transcript (int), ref, strand, exons."""
    coded = settled(transcripts.select("locus", "transcript", "ref", "strand", "exons", _features(F.col("exons")).alias("features"), F.col("exons")[0]["left"].alias("left"), F.element_at("exons", -1)["right"].alias("right")))
    pairs = joins.interval_join(frags.select("locus", "id", "left", "right", "mass", "features"), coded.select("locus", "transcript", "exons", "features", "left", "right"), ["locus"], bin_width=10_000)
    fits = settled(pairs.where(joins.compatible(F.col("features"), F.col("b_features"))).select("locus", "id", "left", "right", "mass", "features", F.col("b_transcript").alias("transcript"), F.col("b_exons").alias("exons")))

    parts = coded.select("locus", "transcript", F.explode("exons").alias("e")).select("locus", "transcript", "e.*")
    segs = settled(ranges.disjoin(parts.select("locus", "left", "right").distinct(), ["locus"]).select("locus", "left", "right"))
    seg = F.struct(F.col("b_left").alias("left"), F.col("b_right").alias("right"))
    blocks = fits.select("locus", "id", F.explode(F.filter("features", lambda f: f["code"] == "S")).alias("f")).select("locus", "id", "f.left", "f.right").distinct()
    touched = joins.interval_join(blocks, segs, ["locus"]).groupBy("locus", "id").agg(F.array_sort(F.collect_set(seg)).alias("touched"))
    own = joins.interval_join(parts, segs, ["locus"], predicate="contain").groupBy("locus", "transcript").agg(F.array_sort(F.collect_set(seg)).alias("segments"))

    fits = fits.join(touched, ["locus", "id"])
    bin_of = F.array_join(F.transform("touched", lambda s: F.concat(F.lit("["), s["left"].cast("string"), F.lit("-"), s["right"].cast("string"), F.lit("]"))), "")
    fits = settled(fits.withColumn("bin", bin_of))
    counts = fits.select("locus", "id", "bin", "mass").distinct().groupBy("locus", "bin").agg(F.sum("mass").alias("n"))
    sized = coded.select("locus", "transcript", _length(F.col("exons")).alias("length"))
    each = fits.groupBy("locus", "bin", "transcript").agg(F.any_value("touched").alias("touched")).join(sized, ["locus", "transcript"]).join(counts, ["locus", "bin"])
    if long_reads:
        weighed = each.withColumn("weight", 1.0 / F.col("length"))
    else:
        density, least = _density(fits, frags, options)
        hidden = abundance.under_isoform(F.col("segments"), F.col("touched"))
        weighed = each.join(own, ["locus", "transcript"]).withColumn("u", hidden).withColumn("weight", abundance.bin_weights(F.col("u.lengths"), F.col("u.implicit"), F.col("length"), read_length, density, least))
    if total is None:
        mass = frags.join(coded.select("locus").distinct(), "locus", "left_semi").groupBy("locus").agg(F.floor(F.sum("mass")).alias("m"))
        total = mass.agg(F.sum("m").alias("total"))
    return Bins(fits, settled(weighed.select("locus", "bin", "n", "transcript", "weight")), settled(total))


def _density(fits: DataFrame, frags: DataFrame, options: Options):
    """Fragment lengths' density, and the least length where it was observed (else None: the read's).

    Given a mean and deviation, or without mates (200, 80), it is a normal one; else that of the fragments that fit one transcript.
    """
    paired = not frags.where(~fragments.is_single(F.col("features"))).isEmpty()
    if options.insert_size or not paired:
        mean, sd = options.insert_size or (200.0, 80.0)
        return abundance.normal_density(mean, sd, int(mean + 6 * sd)), None
    alone = fits.groupBy("locus", "id").agg(F.count("*").alias("n"), F.any_value(fragments.length_within(F.col("exons"), F.col("left"), F.col("right"))).alias("len")).where("n = 1")
    sizes = settled(abundance.insert_sizes(alone))
    first = sizes.agg(F.min("len")).first()[0]
    return abundance.density_of(sizes), first


def quantify(transcripts: DataFrame, found: Bins, options: Options) -> DataFrame:
    """transcripts with length, theta, fpkm, frac and tpm."""
    theta = abundance.em_abundance(found.bins.select("locus", "bin", "n", F.col("transcript").cast("long").alias("isoform"), "weight"))
    sized = transcripts.withColumn("length", _length(F.col("exons")))
    # A transcript that no read fits has none; one in a locus without any read isn't there.
    seen = found.bins.select("locus").distinct()
    rows = sized.join(seen, "locus", "left_semi").join(theta.select("locus", F.col("isoform").cast("int").alias("transcript"), "theta"), ["locus", "transcript"], "left").fillna(0.0, ["theta"])
    return abundance.normalise(rows, "locus", "theta", "length", options.fraction, found.total)


def context(done: DataFrame, found: Bins, sample: str, genome: DataFrame | None = None) -> DataFrame:
    """The fragment context table: a row for each path of segments in a gene.  genome: name, seq.

    Conditional probabilities are the path's weight under each of the gene's transcripts, class
    probabilities their shares; paths count distinct fragments.
    """
    order = F.array_sort(F.collect_list(F.struct("transcript", "transcript_id", "fpkm", "frac")))
    genes = done.groupBy("locus", "ref", "gene_id").agg(order.alias("t"))
    number = lambda x: F.format_string("%.6f", x)
    paths = found.fits.select("locus", "id", "bin", "touched").distinct().groupBy("locus", "bin").agg(F.count("*").alias("path_count"), F.any_value("touched").alias("touched"))
    paths = paths.withColumn("gene_frag_count", F.sum("path_count").over(Window.partitionBy("locus")))
    weights = found.bins.groupBy("locus", "bin").agg(F.map_from_entries(F.collect_list(F.struct("transcript", "weight"))).alias("w"))
    rows = paths.join(weights, ["locus", "bin"]).join(genes, "locus").join(F.broadcast(found.total.toDF("__total")))
    listed = lambda f: F.array_join(F.transform("t", f), ",")
    out = rows.select(
        F.lit(sample).alias("sample"), F.col("__total").alias("sample_frag_count"), "gene_id", "gene_frag_count",
        listed(lambda t: t["transcript_id"]).alias("transcripts"), listed(lambda t: number(t["fpkm"])).alias("FPKMs"),
        listed(lambda t: F.format_string("%.12f", F.coalesce(F.try_element_at("w", t["transcript"]), F.lit(0.0)))).alias("conditional_probabilities"),
        listed(lambda t: number(t["frac"])).alias("class_probabilities"), F.col("bin").alias("path_symbol"), "path_count", "ref", "touched",
    )
    if genome is None:
        return out.drop("ref", "touched")
    return contexts.with_genome(out, genome)


def _length(exons):
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + e["right"] - e["left"] + 1)


def _features(exons):
    """Exons and the introns between them as features."""
    part = lambda code, left, right: F.struct(F.lit(code).alias("code"), left.alias("left"), right.alias("right"))
    both = F.transform(exons, lambda e, i: F.when(i == 0, F.array(part("S", e["left"], e["right"]))).otherwise(F.array(part("I", F.get(exons, i - 1)["right"] + 1, e["left"] - 1), part("S", e["left"], e["right"]))))
    return F.flatten(both)


@dataclass
class Result:
    """transcripts (rows for ``gtf.lines``), the context table and log lines; both of the latter None without quantification."""

    transcripts: DataFrame
    context: DataFrame | None
    log: DataFrame | None


def analyse(reads: DataFrame, options: Options, annotation: DataFrame | None = None, sample: str = "sample", genome: DataFrame | None = None) -> Result:
    """As ``run``, with all that a run makes."""
    hits = valid_hits(reads, options)
    length, long_reads = inspected(hits, options)
    total = None
    if options.no_assembly:
        order = Window.partitionBy("locus").orderBy("transcript_id")
        done = reference_loci(annotation).withColumn("transcript", F.row_number().over(order)).withColumnRenamed("chrom", "ref")
    else:
        given = None if annotation is None else settled(reference_loci(annotation))
        loci = None if given is None else given.select(F.col("chrom").alias("ref"), "locus", F.col("locus_left").alias("left"), F.col("locus_right").alias("right")).distinct()
        frags = fragments_of(settled(with_loci(hits, options, loci)))
        made = assemble(frags, options, length, given)
        mass = frags.join(made.select("locus").distinct(), "locus", "left_semi").groupBy("locus").agg(F.floor(F.sum("mass")).alias("m"))
        total = mass.agg(F.sum("m").alias("total"))
        place = made.groupBy("part", "ref").agg(F.min(F.col("exons")[0]["left"]).alias("at"))
        ids = numbering.numbered(place, ["ref", "at", "part"], "gene").select("part", "gene")
        done = made.join(ids, "part").withColumn("gene_id", F.concat_ws(".", F.lit(sample), "gene")).withColumn("transcript_id", F.concat_ws(".", "gene_id", "transcript"))
        if given is not None:
            first = given.groupBy("locus").agg(F.min_by("gene_id", "transcript_id").alias("ref_gene_id"), F.min_by("gene_name", "transcript_id").alias("ref_gene_name") if "gene_name" in given.columns else F.lit(None).cast("string").alias("ref_gene_name"))
            done = done.join(first, "locus", "left")
        # What was assembled is the reference of the second pass; a gene is a locus.
        done = settled(done.withColumn("locus", F.xxhash64("ref", "part")).drop("part"))
    more = [c for c in ("ref_gene_id", "ref_gene_name") if c in done.columns]
    if options.no_quant and not options.no_assembly:
        return Result(done.select(F.col("ref").alias("chrom"), "strand", "gene_id", "transcript_id", "exons", *more), None, None)
    found = exon_bins(assigned(hits, done), done, options, length, long_reads, total)
    done = settled(quantify(done, found, options))
    number = lambda c: F.format_string("%.6f", c)
    rows = done.select(F.col("ref").alias("chrom"), "strand", "gene_id", "transcript_id", "exons", *more, number(F.col("fpkm")).alias("FPKM"), number(F.col("frac")).alias("Frac"), number(F.col("tpm")).alias("TPM"))
    raw = done.select(F.format_string("%s: isoform %d has %f raw read count.", "gene_id", "transcript", "theta").alias("line"))
    poor = hits.agg(F.format_string("%d kept reads have a mapping quality below %d.", F.count_if("poor"), F.lit(options.min_mapping_quality)).alias("line"))
    return Result(rows, context(done, found, sample, genome), poor.unionByName(raw) if options.verbose else poor)


def run(reads: DataFrame, options: Options, annotation: DataFrame | None = None, sample: str = "sample", genome: DataFrame | None = None) -> DataFrame:
    """Rows for ``gtf.lines``: chrom, strand, gene_id, transcript_id, exons, FPKM, Frac, TPM.

    annotation: chrom, strand, gene_id, transcript_id, exons.  With ``no_assembly`` its transcripts
    are quantified as they are; else they guide the assembly, and rows name the gene that guided them.  Genes
    are numbered in order of place.  The options' output, context and log are written where they are named.
    """
    if genome is None and options.genome:
        from tessella.sources import fasta

        genome = fasta.read(reads.sparkSession, options.genome)
    if annotation is None and options.annotation:
        annotation = gtf.load_annotation(gtf.read(reads.sparkSession, options.annotation), reads.select("ref").distinct())
    made = analyse(reads, options, annotation, sample, genome)
    if options.output:
        gtf.write(made.transcripts, options.output, header="tessella")
    if options.context and made.context is not None:
        contexts.write(made.context, options.context)
    if options.log and made.log is not None:
        made.log.write.mode("errorifexists").text(options.log)
    return made.transcripts
