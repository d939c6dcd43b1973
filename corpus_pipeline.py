"""From documents to token ids: language, near copies, personal data, mixture, tokens.

Every stage reads what its predecessor wrote. All but the last return the
columns of ``documents``; see each operator's module for nulls, empty texts,
repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import bpe, langid, mixing, omh, pii
from parchmill.llm.common import columns, fresh, materialize, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; a missing ``lang`` is filled in."""
    (name,) = fresh(docs, "lang")
    found = docs.withColumn(name, langid.accepted_language(spark, F.col("text"), langid.fit(docs)))
    return found.where(F.col(name).isNotNull()).withColumn("lang", F.coalesce("lang", name)).select(*columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return omh.without_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked; ``n_chars`` follows the text."""
    (name,) = fresh(docs, "text")
    masked = docs.withColumn(name, pii.redacted(F.col("text")))
    same = F.col("text").eqNullSafe(F.col(name))
    length = F.when(same, F.col("n_chars")).otherwise(F.length(name).cast("long"))
    return masked.withColumn("n_chars", length).withColumn("text", F.col(name)).select(*columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample in which every source has its target share of tokens."""
    return mixing.drawn(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]
#: SQL expresses neither the network, nor the sketches, nor the cube method, nor BPE.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
