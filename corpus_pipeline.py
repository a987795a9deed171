"""Corpus pipeline: five stages over ``documents``, each a Parquet table read by the next.

All columns of documents, of whatever names, pass through the first four stages. Texts of any length
are judged and encoded whole; an empty table stays empty. Bytes that are no UTF-8 count as they are for
comparing texts and as U+FFFD for encoding. What each stage makes of nulls, empty texts and repeated
rows is said there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontaminate, minhash, quality, substrings
from siftwell.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Each row is judged by itself, so repeated rows share their lot; null text, source or language count as
    empty. Without labels of both kinds nothing is rejected.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest doc_id.

    Of repeated rows one stays, rows of one doc_id go together; a null or empty text is like no other and stays, as does a row without doc_id.
    """
    return minhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more cut out of all but their first document (smallest doc_id); n_chars follows.

    Different texts of one doc_id are documents of their own; null and empty texts and rows without doc_id stay as they are.
    """
    cut = substrings.remove_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Each row is judged by itself; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their byte offsets, and a digest of the decoded bytes, a row for each row; null and empty texts have no ids."""
    decoded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the trained and the fuzzy stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
