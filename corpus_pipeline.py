"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, language_id, near_dedup, packing, piece_tokens, secret_scan, shared

#: A document whose language is told with less than this probability is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network tells; without letters or certainty they go."""
    net = language_id.fit(docs)
    told = "told"
    while told in docs.columns:
        told += "_"
    sure = (F.col(f"{told}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{told}.score") >= LEAST_LANGUAGE_SCORE)
    return docs.withColumn(told, language_id.language("text", net)).filter(sure).drop(told)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return near_dedup.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and masks the secrets in their texts."""
    return secret_scan.without_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of the permitted lengths: one row a sequence, with its ids and documents."""
    # A text has no more tokens than bytes, and two that mark its ends.
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return packing.pack_ids(piece_tokens.encode(docs), rows=rows, tokens=size + 2 * rows)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages hold a trained network, a confirmed near-copy join and a packing: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder, so no stage is computed again by a later one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
