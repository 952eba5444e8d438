"""The queries ``opN_<name>``: each applies its operator to whole tables and returns the whole result.

``TOKENIZER`` and ``PIECES`` name vocabulary files; their place is asked of the installed package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, decontam, langid, materialise, quality_rules, simhash, toxicity, weaklabels

TOKENIZER = "word_bpe_49k.json"
#: Its id of <|endoftext|>, which fills sequences up.
END_OF_TEXT = 49407
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = chat_rows(spark, sf_dir)
    return chat.read_back(chat.format_turns(both))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    marked = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return marked.withColumn("contaminated", F.col("n_hit") > 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.rules(docs, trusted).select("doc_id", "quality.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    machine = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine, out="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digest(docs, tokenizer_path()).select("doc_id", "encoded.*")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out), tokenizer_path(PIECES))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "language.*")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the shards that were written, with a digest of its ids as read back."""
    path = tokenizer_path()
    folder, packed = materialise.shared_folder(spark), materialise.shared_folder(spark)
    ordered = materialise.training_order(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pad=END_OF_TEXT, key=20, packed=packed)
    index = materialise.write_shards(ordered, folder)
    materialise.removed(spark, packed)  # index and shards are read from their own files
    read = materialise.read_shards(spark, folder, width=materialise.id_bytes(path))
    return index.withColumnRenamed("docs", "doc_ids").join(read.select("slot", F.sha2("payload", 256).alias("payload_sha256")), "slot")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, scorer = weaklabels.train(docs)
    return weaklabels.classify(docs, scorer, out="score").withColumn("kept", F.col("score") >= weaklabels.THRESHOLD).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = bpe.count_tokens(docs, tokenizer_path())
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_training_order": op8_training_order,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontam.ORACLE,
}
