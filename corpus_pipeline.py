"""A corpus pipeline: language ID, near-dedup, substring dedup, secret redaction, packing; each stage reads the last one's table.

All stages but the last keep every column of documents, whatever extra columns are called, and take an empty table to an empty one.
Texts of any length are read whole. Repeated rows are rows like any others: equal ones share each stage's decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelwave.llm import langid, packing, secrets, simhash, substring
from voxelwave.llm.queries import vocab
from voxelwave.runtime import cut, drop, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found, or not with a calibrated score of 0.35, go: null, empty and letterless texts too.

    Without any labelled row no language can be found, so all go. Rows without an id are judged like others.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id (all rows that share it).

    Null and empty texts are copies of each other; rows without an id stay.
    """
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by windows that an earlier document has are cut from texts, which may become empty; no row goes.

    Null and short texts and rows without an id stay as they are; rows that share an id do not cut each other.
    """
    return substring.remove_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one; null texts stay null, and no row goes."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences; a null or empty text is one piece, the end token alone."""
    return packing.pack_documents(docs, vocab())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: A learned stage and hashed stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
            if k:
                drop(before)
    return docs
