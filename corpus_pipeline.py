"""The corpus pipeline: documents in, token ids of clean, deduplicated and decontaminated documents out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of docs.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, ngram_join, quality, substring_dedup, toxicity
from sparkloom.llm.blocks import columns
from sparkloom.llm.graph import drop, written
from sparkloom.llm.queries import fold
from sparkloom.sources import table

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality. Learns from the labels outside the held-out fold, as op6 does."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(fold(5) != 0))
    scored = toxicity.score(docs, model, F.struct(*columns(docs.columns)).alias("row"))
    return scored.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates. Rows that repeat that doc_id are that document too."""
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words and more that occur elsewhere. n_chars, where there is such a column, follows the new text."""
    out = substring_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(columns(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, and decodes them again for the digest."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL can't express a trained classifier or greedy tiling; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a data directory."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            drop(spark, before)  # what this stage read; its result is a table by now
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
