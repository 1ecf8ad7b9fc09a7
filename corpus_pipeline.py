"""A corpus pipeline of five operators: language ID, exact dedup, SimHash near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents. Null ids and texts, repeated rows
and extra columns pass as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontam, exact_dedup, lang_id, simhash
from tracelake.llm.common import drop_ids, remainder, stored
from tracelake.llm.queries import bpe_digests

#: Posterior of the best language under which a document has no language.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or without a likely language go."""
    model = lang_id.fit(docs.where(remainder("doc_id", 5) != 0))
    return docs.where(lang_id.accepts(spark, model, LEAST_SCORE)(F.col("text")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, repeated rows included."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. An id goes if none of its rows stays."""
    found = simhash.simhash_components(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.groupBy("doc_id").agg(F.bool_or(stays).alias("stays")).where("not stays").select("doc_id")
    return drop_ids(docs, gone)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    return bpe_digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("benchmark_decontamination", benchmark_free), ("byte_level_bpe", encode)]

#: SQL can't express the language model, the fingerprints or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
