"""GTF and GFF3: parsing lines to columns, transcripts with nested exons, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE, SCORE = "tessella", "1000"
#: A number in an attribute keeps so many characters.
NUMBER_CHARS = 11


def attribute(attributes: Column, name: str) -> Column:
    """An attribute's value, quoted (GTF) or after ``=`` (GFF3); null if it isn't there."""
    found = F.regexp_extract(attributes, f'(?i)(?:^|;)\\s*{name}[ =]"?([^";]*)"?', 1)
    return F.nullif(F.trim(found), F.lit(""))


def kind(of: Column) -> Column:
    """A line's type, by what its name contains; null for types that aren't read."""
    low = F.lower(of)
    return (
        F.when(low.contains("utr"), "utr")
        .when(low.contains("exon"), "exon")
        .when(low.contains("stop") & (low.contains("codon") | low.contains("cds")), "stop_codon")
        .when(low.contains("start") & (low.contains("codon") | low.contains("cds")), "start_codon")
        .when(low == "cds", "cds")
        .when(low.contains("rna") | low.contains("transcript"), "transcript")
        .when(low.contains("gene"), "gene")
    )


def parse(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of a column ``value`` as columns; comments, short lines, other types and lines without coordinates are left out.

    strict: lines with a numeric score are dropped, as a reader would that gives up after the score.
    """
    part = F.col("__part")
    # Split by a generator, past which no filter is pushed: a split column would be split anew wherever it is named.
    whole = lines.where(~F.col("value").startswith("#") & (F.length("value") >= 10))
    rows = whole.select(F.explode(F.array(F.split("value", "\t"))).alias("__part")).where(F.size(part) >= 9)
    if strict:
        rows = rows.where(F.trim(part[5]) == ".")
    start, stop, at = part[3].try_cast("long"), part[4].try_cast("long"), part[8]
    gene_name = F.coalesce(*(attribute(at, n) for n in ("gene_name", "genename", "gene_sym", "gene", "name")))
    out = rows.select(
        part[0].alias("chrom"),
        part[1].alias("source"),
        kind(part[2]).alias("kind"),
        F.least(start, stop).alias("left"),
        F.when(start.isNotNull() & stop.isNotNull(), F.greatest(start, stop)).alias("right"),
        part[5].try_cast("double").alias("score"),
        part[6].alias("strand"),
        part[7].alias("phase"),
        F.coalesce(attribute(at, "gene_id"), F.when(kind(part[2]) == "gene", attribute(at, "ID"))).alias("gene_id"),
        gene_name.alias("gene_name"),
        F.coalesce(attribute(at, "transcript_id"), F.when(kind(part[2]) == "transcript", attribute(at, "ID"))).alias("transcript_id"),
        attribute(at, "Parent").alias("parent"),
    )
    return out.where("kind is not null and right is not null")


def _exons(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'exon'").withColumn("transcript_id", F.coalesce("transcript_id", "parent"))


def transcripts(parsed: DataFrame) -> DataFrame:
    """Exons by transcript, in order and each once; GFF3 exons find transcript and gene by parent.

    Lines are dealt by transcript once, for the join and both groupings; equal ones are one before they are collected.
    """
    owner = parsed.where("kind = 'transcript'").select(F.col("transcript_id").alias("__t"), F.coalesce("gene_id", "parent").alias("__g")).where("__t is not null").distinct()
    dealt = _exons(parsed).select("chrom", "strand", "gene_id", "transcript_id", "left", "right", "gene_name").repartition("transcript_id")
    exon = dealt.groupBy("chrom", "strand", "gene_id", "transcript_id", "left", "right").agg(F.min("gene_name").alias("gene_name"))
    named = exon.join(owner, exon["transcript_id"] == owner["__t"], "left").withColumn("gene_id", F.coalesce("gene_id", "__g"))
    own = named.groupBy("chrom", "strand", "gene_id", "transcript_id").agg(F.sort_array(F.collect_set(F.struct("left", "right"))).alias("exons"), F.min("gene_name").alias("gene_name"))
    return own


def genes(own: DataFrame) -> DataFrame:
    """Genes of ``transcripts``: their ends, transcripts, and exons in order, each once in the gene.

    Exons and transcripts are rows that are made distinct before they are collected, as a gene's exons in one
    array would be compared each with each.
    """
    gene = ["chrom", "strand", "gene_id"]
    row = lambda left, right, t: F.struct(left.alias("left"), right.alias("right"), t.alias("t"))
    parts = F.concat(F.transform("exons", lambda e: row(e["left"], e["right"], F.lit(None).cast("string"))), F.array(row(F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("transcript_id"))))
    each = own.select(*gene, "gene_name", F.explode(parts).alias("p")).groupBy(*gene, "p.left", "p.right", "p.t").agg(F.min("gene_name").alias("gene_name"))
    exon = F.when(F.col("left").isNotNull(), F.struct("left", "right"))
    rows = each.groupBy(*gene).agg(F.sort_array(F.collect_list(exon)).alias("exons"), F.sort_array(F.collect_list("t")).alias("transcripts"), F.min("gene_name").alias("gene_name"))
    return rows.withColumn("left", F.col("exons")[0]["left"]).withColumn("right", F.array_max(F.transform("exons", lambda e: e["right"])))


def unknown(parsed: DataFrame, refs: DataFrame) -> DataFrame:
    """How many transcripts lie on each chromosome that isn't one of the references."""
    known = refs.select(F.lower("ref").alias("__low"))
    return transcripts(parsed).join(known, F.lower("chrom") == F.col("__low"), "left_anti").groupBy("chrom").agg(F.count("*").alias("n_transcripts"))


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    if not path.lower().endswith((".gtf", ".gff3")):
        raise ValueError(f"{path}: an annotation ends in .gtf or .gff3")
    return parse(spark.read.text(path), strict)


def load_annotation(parsed: DataFrame, refs: DataFrame) -> DataFrame:
    """Transcripts on known references (names match whatever their case); fails if none is known."""
    known = refs.select(F.lower("ref").alias("__low"), F.col("ref").alias("__ref"))
    # The look is at lines, up to the first on a known reference, and not at transcripts, which would all be made for it.
    # Names that no reference has are left out, and ``unknown`` counts them.
    exon = _exons(parsed)
    if exon.join(F.broadcast(known), F.lower("chrom") == F.col("__low"), "left_semi").isEmpty() and not exon.isEmpty():
        raise ValueError("no chromosome of the annotation is one of the alignments")
    return transcripts(parsed).join(known, F.lower("chrom") == F.col("__low")).withColumn("chrom", F.col("__ref")).drop("__low", "__ref")


def lines(transcripts: DataFrame) -> DataFrame:
    """GTF lines in order: a transcript's, then its exons'.

    transcripts: chrom, strand, gene_id, transcript_id, exons, and if there are such columns
    ref_gene_id, ref_gene_name, FPKM, Frac, TPM, whose nulls are left out.
    """
    def pair(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'{name} "'), value, F.lit('";'))

    more = [pair(n, F.substring(F.col(n).cast("string"), 1, NUMBER_CHARS) if n in ("FPKM", "Frac", "TPM") else F.col(n)) for n in ("ref_gene_id", "ref_gene_name", "FPKM", "Frac", "TPM") if n in transcripts.columns]
    attributes = F.concat_ws("", pair("gene_id", F.col("gene_id")), pair("transcript_id", F.col("transcript_id")), *more)
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")

    def line(of: str, left: Column, right: Column, tail: Column) -> Column:
        return F.concat_ws("\t", F.col("chrom"), F.lit(SOURCE), F.lit(of), left.cast("string"), right.cast("string"), F.lit(SCORE), strand, F.lit("."), tail)

    own = F.array(F.struct(F.lit(0).alias("place"), line("transcript", F.col("exons")[0]["left"], F.array_max(F.transform("exons", lambda e: e["right"])), attributes).alias("line")))
    parts = F.transform("exons", lambda e, i: F.struct((i + 1).alias("place"), line("exon", e["left"], e["right"], F.concat(attributes, F.lit(' exon_id "'), (i + 1).cast("string"), F.lit('";'))).alias("line")))
    return transcripts.select("chrom", "transcript_id", F.explode(F.concat(own, parts)).alias("l")).select("chrom", "transcript_id", "l.*")


def write(transcripts: DataFrame, path: str, header: str = "") -> None:
    """Write lines in order of transcript; an existing path is an error."""
    ordered = lines(transcripts).orderBy("chrom", "transcript_id", "place").select("line")
    if header:
        first = transcripts.sparkSession.createDataFrame([(h,) for h in (f"# {header}", "#" * 40)], "line string")
        ordered = first.coalesce(1).union(ordered)
    ordered.write.mode("errorifexists").text(path)
