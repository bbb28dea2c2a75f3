"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet
to the shared folder and reads again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import bpe, decontaminate, langid, line_dedup, near
from attestor.llm.byte_bpe import vocabulary_path
from attestor.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the stage's own labelled documents. A null lang becomes the predicted one."""
    return langid.keep_known(docs, langid.fit(docs.where(~langid.held_out("doc_id", 4, 2))), lang_col="lang")


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats, exactly or but for an edit; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of it: the one with the smallest id.

    Near duplicates share 0.8 or more of their five-word shingles (Jaccard), compared exactly.
    """
    return near.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to."""
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode", bpe_encode),
]

#: Language ID, near-duplicate groups and BPE are beyond SQL; tests hold each stage and the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
