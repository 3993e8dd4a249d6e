"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.llm import exact, langid, ngram_join, packing, substring
from tonespark.llm.scratch import keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in any mix of the languages that the labelled ones teach; without labels, in any."""
    model = langid.fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(langid.has_letter(F.col("text")))
    made = langid.label(docs.select("text", F.struct("*").alias("whole")), model)
    return made.where(F.col("lang_pred") != "und").select("whole.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, that of the smallest doc_id."""
    return exact.deduplicate(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return ngram_join.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; documents of nothing else stay, with an empty text."""
    made = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast("long"))
    return made.select(*[f"`{c}`" for c in docs.columns])


def cost_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", ngram_jaccard_join), ("substring_dedup", substring_dedup), ("packing", cost_packing)]
#: Languages, near duplicates and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
