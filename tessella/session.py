"""Options of an analysis, and a Spark session with the settings that the operators expect."""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Options:
    """What a run can be told.  Defaults are those of the command line that it replaces."""

    output: str | None = None  # where the run writes GTF lines
    log: str | None = None  # where it writes what it noted; verbose: with the reads of every transcript
    verbose: bool = False
    min_mapping_quality: int = 0
    enforce_mapping_quality: bool = False  # by default a low quality is only reported
    max_intron: int = 300_000
    min_intron: int = 20
    inspected_reads: int = 50_000
    allow_multimapped: bool = False
    library: str | None = None  # fr or rf
    annotation: str | None = None  # a GTF or GFF3 file, read where the run isn't given one
    no_assembly: bool = False
    no_quant: bool = False
    min_transcript_length: int = 200
    gap: int = 50
    small_anchor: int = 10
    anchor_alpha: float = 0.0
    min_junction_reads: int = 2
    min_exon_coverage: float = 1.0
    combine_fragments: bool = False
    min_transcript_depth: float = 1.0
    min_locus_reads: int = 5
    insert_size: tuple[float, float] | None = None  # mean and deviation
    genome: str | None = None  # FASTA, for the sequence columns of the context table
    min_fraction: float = 0.01
    context: str | None = None  # where it writes the fragment context table

    def __post_init__(self):
        if self.library not in (None, "fr", "rf"):
            raise ValueError("library is fr, rf or None")
        if not 0 <= self.min_fraction <= 1:
            raise ValueError("min_fraction lies from 0 to 1")
        if self.min_intron < 1 or self.max_intron < self.min_intron:
            raise ValueError("introns need 1 <= min_intron <= max_intron")
        if self.no_assembly and not self.annotation:
            raise ValueError("without assembly an annotation is needed")
        if self.min_mapping_quality and not self.enforce_mapping_quality:
            warnings.warn("a low mapping quality is only counted in the log; enforce_mapping_quality drops such reads", stacklevel=2)
        if self.min_exon_coverage != 1.0 or self.combine_fragments:
            warnings.warn("min_exon_coverage and combine_fragments have no effect", stacklevel=2)

    @property
    def fraction(self) -> float:
        """The least isoform fraction: none when only given transcripts are quantified."""
        return 0.0 if self.no_assembly else self.min_fraction


def session(name: str = "tessella", **conf: str) -> SparkSession:
    """A session with adaptive execution, skewed joins split, and time in UTC."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read to the shared checkpoint folder, and cut its plan.

    The folder is spark.checkpoint.dir; where that is unset, as in tests, one in the warehouse.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    return df.checkpoint()
