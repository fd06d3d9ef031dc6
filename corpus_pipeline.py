"""Corpus pipeline: STAGES applied one after the other to the table of documents.

Every stage takes rows with null ids, null, empty and very long texts, ties and repeated
rows, empty tables and further columns of any name, and gives a defined result (see each);
all but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finquill.llm import decontamination, line_dedup, ngram_join, quality, sentencepiece_bpe
from finquill.llm.common import cut, table, text_remainder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts get a score as any other; repeated rows stay or go together; without
    labels nothing is rejected.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), text_remainder(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents of which nothing is left go.

    The first occurrence by (doc_id, text, line) stays; null texts, blank lines and rows with a
    null doc_id stay as they are; repeated rows are one document and stay alike.
    """
    return line_dedup.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id.

    Documents without words are alike to none; rows with a null doc_id and repeated rows stay.
    """
    return ngram_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go.

    Null texts and documents without words stay; without items nothing changes.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of each text, and the text decoded from them.

    Null texts give no ids and an empty text; further columns end here.
    """
    import public_tokenizers

    out = sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: The trained and iterative stages can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{k}-{name}")
    return docs
