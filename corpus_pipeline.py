"""Cleaning of a corpus: each stage works on what the one before it kept.

toxicity -> SimHash near-duplicates -> benchmark decontamination -> personal data -> packing.
A stage's result is written to the shared folder and read again, so losing an executor repeats
tasks of one stage, not the pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from failcast.llm import decontaminate, packing, pii, simhash, toxicity
from failcast.llm.common import bounded_batches, fold, table
from failcast.sources.storage import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by models of the labelled rows outside the held-out fold."""
    bounded_batches(spark)
    model = toxicity.train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked at 4 or fewer bits."""
    bounded_batches(spark)
    return simhash.keep_one_of_each(docs, shingle=4, bits=4)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ten words that a benchmark item has."""
    bounded_batches(spark)
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.mask_pii(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, packing.public_vocabulary(), capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_near_copies),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained scores, fingerprint groups and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
