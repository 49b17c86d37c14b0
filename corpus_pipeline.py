"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last return the columns of documents. Defaults of the operators hold: shingles of five words and a
similarity of 0.8 for near-duplicates, repeated line runs of 50 words or more, windows of 10 words
against the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._base import new_path, small_batches
from quillon.llm.bpe_codec import bpe_digests
from quillon.llm.decontaminate import decontaminate
from quillon.llm.language_id import fit, held_out, reject_unknown
from quillon.llm.line_dedup import line_dedup
from quillon.llm.minhash import keep_first


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of its input, but for those held out as in operator 3;
    documents without a language go."""
    small_batches(spark)
    return reject_unknown(docs, fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left; n_chars
    follows the text."""
    small_batches(spark)
    return line_dedup(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    small_batches(spark)
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, encoded and decoded."""
    small_batches(spark)
    return bpe_digests(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express the mixture inference of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and reread for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
