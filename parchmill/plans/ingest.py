"""The whole run: PDFs to TEI text to papers, with failures as data."""

from __future__ import annotations

from contextlib import nullcontext
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import file_stem, tei_path
from ..operators.paper import paper
from ..operators.parse import with_parsed
from ..sources.discovery import pdf_paths
from ..sources.extraction import MAX_CONCURRENT, Extractor, extract
from ..sources.sinks import Progress, collapse, summary, write_json_files, write_table, write_tei_files


class Run(NamedTuple):
    papers: DataFrame
    status: DataFrame
    summary: DataFrame


def parse_documents(docs: DataFrame) -> DataFrame:
    """``docs(path, stem, tei_xml, ...)`` with ``paper`` and its error. No shuffle."""
    parsed = with_parsed(docs)
    failed = F.col("tei_xml").isNotNull() & F.col("flat.error").isNotNull()
    kind = F.when(failed, F.lit("parse")).otherwise(F.col("error_kind")) if "error_kind" in docs.columns else F.when(failed, F.lit("parse"))
    old = F.col("error_message") if "error_message" in docs.columns else F.lit(None).cast("string")
    message = F.when(failed, F.concat(F.lit("failed to parse TEI XML: "), "flat.error")).otherwise(old)
    keep = [c for c in docs.columns if c not in ("error_kind", "error_message")]
    return parsed.select(*keep, F.when(F.col("tei_xml").isNotNull(), paper(F.col("flat"))).alias("paper"), kind.alias("error_kind"), message.alias("error_message"))


def status_of(parsed: DataFrame) -> DataFrame:
    """``path, failed, errors`` per document. Documents that share a stem write the same files: each is told so."""
    twins = F.count("*").over(W.partitionBy("stem"))
    errors = F.array_compact(F.array(collapse(F.col("error_message"))))
    return parsed.select("path", F.col("error_message").isNotNull().alias("failed"), errors.alias("errors"), (twins > 1).alias("shares_stem"))


def _failed(docs: DataFrame, failures: DataFrame, kind: str, words: str, content: str) -> DataFrame:
    """``docs`` whose rows among ``failures(path, message)`` have that error and no ``content``."""
    bad = failures.groupBy("path").agg(F.min("message").alias("__pm_message"))
    hit = F.col("__pm_message").isNotNull()
    joined = docs.join(bad, "path", "left")
    changed = {content: F.when(~hit, F.col(content)), "error_kind": F.when(hit, kind).otherwise(F.col("error_kind")), "error_message": F.when(hit, F.concat(F.lit(words), "__pm_message")).otherwise(F.col("error_message"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def ingest(spark: SparkSession, source: str, tei_dir: str, json_dir: str, table_dir: str, extractor: Extractor, concurrent: int = MAX_CONCURRENT, show_progress: bool = False) -> Run:
    """TEI text is stored before it is parsed, so it survives a parse failure and can be parsed again without extraction.

    A document that cannot be read, extracted, stored, parsed or exported is a row with its error; the others go on.
    """
    paths = pdf_paths(spark, source)
    paths = paths.withColumn("stem", file_stem(F.col("path")))
    done = spark.sparkContext.accumulator(0)
    with Progress(lambda: done.value, paths.count(), concurrent) if show_progress else nullcontext():
        bronze = write_table(extract(paths, extractor, concurrent, done), f"{table_dir}/tei")
    unsaved = write_table(write_tei_files(bronze, tei_dir), f"{table_dir}/tei_failures")
    saved = _failed(bronze, unsaved, "tei_write", "failed to write TEI XML: ", "tei_xml")
    parsed = write_table(parse_documents(saved).withColumn("tei_path", tei_path(tei_dir, F.col("stem"))), f"{table_dir}/papers")
    unexported = write_table(write_json_files(parsed, json_dir), f"{table_dir}/json_failures")
    status = status_of(_failed(parsed, unexported, "json_write", "failed to export domain paper as JSON: ", "paper"))
    return Run(parsed, status, summary(status))
