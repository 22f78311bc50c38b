"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity drops documents predicted toxic; near_dedup keeps the document of least doc_id of each group of near copies (5-word
shingles, similarity 0.8); decontamination drops documents that hold a benchmark item; pii replaces personal data in the texts that
are left; encode turns each text into token ids, with the digest of the text that they decode to; it compares nothing itself, tests do. All but
the last return the columns of documents. SQL can't express the learned, hashed and tokenised stages, so ORACLE_SQL is None; tests
compare near_dedup and decontamination with brute force, and pii and encode with their operators and digests, row by row.

Defined cases: rows with a null or empty text, or a null doc_id, pass every stage (null texts stay null, and have no tokens); equal texts are
near copies, so the least doc_id stays, with all its rows; repeated rows of a document that stays stay; very long texts are handled whole;
further columns are carried along; without labels nothing is toxic, without a benchmark nothing leaks; an empty table gives an empty result.
A stage's table is deleted when the next one is written; that of the last is what run() reads, in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bpe, decontaminate, minhash, pii, toxicity
from inkstone.llm.common import delete_shared, fold, shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled training folds of docs; rejects what is predicted toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.reject_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates_removed(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("encode", encode_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the stages' tables are in the shared folder. Rows carry digests in place of the ids."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete_shared(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.size("ids").cast("long").alias("n_ids"))
