"""A corpus pipeline of five stages, each of which works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs.  Stages but the last keep
the columns of documents, whatever their names.  Models are trained on the stage's own input.  Null
and empty texts and texts without a letter are rejected by the first stage; repeated rows fall in the
third; texts of any length are worked on whole; an empty table passes through every stage as an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, langid, simhash, weaklabels
from tessella.llm.exprs import col, fresh
from tessella.llm.materialise import removed, stored
from tessella.llm.queries import PIECES, tokenizer_path

#: A document whose language has less posterior than this is rejected, as one that has none.
LEAST_LANGUAGE = 0.5


def _judged(docs: DataFrame, made: DataFrame, keep) -> DataFrame:
    return made.where(keep).select(*(col(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognisable language go."""
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), tokenizer_path(PIECES))
    (out,) = fresh(docs.columns, "__language")
    found = langid.identify(docs, model, out=out)
    return _judged(docs, found, (F.col(out)["lang_pred"] != langid.UND) & (F.col(out)["score"] >= LEAST_LANGUAGE))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that the scorer takes for bad go."""
    _, scorer = weaklabels.train(docs)
    (out,) = fresh(docs.columns, "__score")
    return _judged(docs, weaklabels.classify(docs, scorer, out=out), F.col(out) >= weaklabels.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of documents linked by a 5-word Jaccard similarity of 0.8 or more one stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of it go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, benchmark, remove="documents")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: the token ids of every document that is left."""
    (out,) = fresh(docs.columns, "__encoded")
    found = bpe.encode(docs, tokenizer_path(), out=out)
    return found.select("doc_id", "lang", "source", F.col(out)["n_tokens"].alias("n_tokens"), F.col(out)["ids"].alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can express none of the learned stages, hashes or merges; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is a table in the shared folder, until the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        folder = stored(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
