"""The corpus pipeline: five stages, each over all that the one before it kept.

``run`` writes what each stage returns as Parquet into the shared folder and reads it again for the next one; once the next
one's rows are written, they go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spreadloom.llm import bpe, decontaminate, exactdedup, langid, minhash
from spreadloom.llm.store import dropped, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known with a mean probability of at least one half.

    The network learns from the labelled documents that are not held out. Texts that are null or have no letter go;
    nulls in other columns and repeated rows do not matter, and an empty table stays empty.
    """
    settings = langid.Settings()
    net = langid.train(langid.sample(docs.where(~langid.held_out()), settings), settings)
    return langid.identified(docs, net, settings)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each set of equal texts (see ``exactdedup.without_copies``)."""
    return exactdedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near duplicates (see ``minhash.classes``)."""
    return minhash.without_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no window of a benchmark item occurs (see ``decontaminate.hits``)."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text (see ``bpe.encode_decode``)."""
    return bpe.encode_decode(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("bpe", encode)]

#: No SQL expresses a trained network, sampled signatures or BPE merges; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
