"""From raw documents to packed training sequences; each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import language_id, ngram_join, packing, pii
from graphloom.llm.shared import shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is found (operator 10).

    Null and empty texts, and texts without a letter, go. Rows are judged one by one, on their whole texts, so repeated rows share a fate, and null ids
    and other columns stay as they are. An empty table stays empty.
    """
    return language_id.keep_accepted(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of exact or near copies (operator 9).

    Documents without words or without doc_id stay. Rows that repeat a doc_id are one document, kept or dropped together; of ties in similarity all count.
    Texts of any length are compared whole. An empty table stays empty.
    """
    return ngram_join.keep_one_per_group(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each entity in its place (operator 1).

    Null texts stay null and empty ones empty; repeated rows are redacted alike; long texts are read whole; of labellings that tie the
    one with fewer entities stands. Ids and other columns stay as they are, but for n_chars, which is counted anew. An empty table stays empty.
    """
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences (operator 2): a row for each piece of a document, with its bin.

    Null and empty texts take no place; a null doc_id and repeated rows are packed like any other; long texts become several pieces; pieces of
    one length go by doc_id, equal bins by age. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Mixture inference, the semi-Markov field and best-fit are iterative; SQL can't express them. tests/llm has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``; what they hand on lies in the cluster's shared folder."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
