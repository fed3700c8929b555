"""A corpus made ready for training: five stages, each a function of a session, documents and a table folder.

Every stage returns a DataFrame that is written as Parquet and read again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import bpe, decontaminate, line_dedup, near_dedup
from cloakwork.llm.queries import languages, table, vocabulary
from cloakwork.session import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language: what is likelier in none goes."""
    found = languages(spark, docs, sf_dir).where("rejected").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__gone"), "left_anti")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are elsewhere; those of which nothing is left go."""
    left = line_dedup.dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, four fifths in common."""
    return near_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids and the text that they decode to."""
    return bpe.tokenize(docs, vocabulary()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding_decoding", bpe_encoding),
]

# Trained language tables and edit distances are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
