"""Finding and reading input files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_stem, is_pdf

#: Files of one task: reading and extracting a file is costly next to listing it.
FILES_PER_TASK = 64


class InvalidInput(ValueError):
    """The input holds nothing to process, or is not what it should be."""


def _is_pdf(name: str) -> bool:
    stem, dot, ending = name.rpartition(".")
    return bool(dot and stem.strip(".")) and ending.lower() == "pdf"


def pdf_paths(spark: SparkSession, source: str) -> DataFrame:
    """``path`` of the PDF itself, or of the PDFs of a directory (not below it), in order; names may begin with ``_``.

    The listing is that of one directory, on the driver; a remote directory is
    listed through Hadoop's file system.
    """
    if "://" in source:
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(source)
        hadoop = target.getFileSystem(sc._jsc.hadoopConfiguration())
        if not hadoop.exists(target):
            raise InvalidInput(f"No such file or directory: {source}")
        found = [source] if hadoop.getFileStatus(target).isFile() else [s.getPath().toString() for s in hadoop.listStatus(target) if s.isFile()]
        single = hadoop.getFileStatus(target).isFile()
    elif os.path.isfile(source):
        found, single = [source], True
    elif os.path.isdir(source):
        found, single = [e.path for e in os.scandir(source) if e.is_file()], False
    else:
        raise InvalidInput(f"No such file or directory: {source}")
    if single and not _is_pdf(os.path.basename(source)):
        raise InvalidInput(f"Path is not a PDF file: {source}")
    kept = sorted(p for p in found if _is_pdf(p.rpartition("/")[2]))
    if not kept:
        raise InvalidInput(f"No PDF files found in {source}")
    return spark.createDataFrame(pa.table({"path": pa.array(kept, pa.string())}))


def filter_pdf(paths: DataFrame) -> DataFrame:
    """The same rule over a table of paths, on the executors."""
    return paths.where(is_pdf(F.col("path"))).orderBy("path")


def file_bytes(path: str) -> bytes:
    """A file's content, from any file system that the path names."""
    store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    with store.open_input_stream(inner) as f:
        return f.read()


def read_pdfs(spark: SparkSession, source: str) -> DataFrame:
    """``path, stem, content, error_message`` of every PDF, read on the executors; a file that cannot be read is a row with its error.

    Spark's own file sources skip names that begin with ``_`` or ``.``, even
    when they are named one by one; here every listed path is opened.
    """
    paths = pdf_paths(spark, source)
    tasks = max(1, -(-paths.count() // FILES_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                content = error = None
                try:
                    content = file_bytes(path)
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error_message"])

    files = paths.repartition(tasks, "path").mapInArrow(run, "path string, content binary, error_message string")
    return files.select("path", file_stem(F.col("path")).alias("stem"), "content", "error_message")


def _empty_tei(source: str) -> list[str]:
    """URIs of the TEI files of a directory that hold nothing, named as Spark names the others."""
    store, inner = fs.FileSystem.from_uri(source if "://" in source else "file://" + quote(os.path.abspath(source)))
    found = store.get_file_info(fs.FileSelector(inner)) if store.get_file_info(inner).type == fs.FileType.Directory else []
    root = re.match("[^:/]+:(?://[^/]+)?", source)[0] if "://" in source else "file:"
    return sorted(root + quote(f.path, safe="/!$&'()*+,:;=@~") for f in found if f.is_file and f.size == 0 and f.extension.lower() == "xml" and f.base_name[0] not in "._")


def read_tei(spark: SparkSession, source: str) -> DataFrame:
    """``path, tei_xml`` of the TEI files of a directory, each read whole. Spark lists no file without content, so these are added."""
    read = spark.read.text(source, wholetext=True, pathGlobFilter="*.[xX][mM][lL]").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("tei_xml"))
    empty = _empty_tei(source)
    if not empty:
        return read
    return read.union(spark.createDataFrame(pa.table({"path": pa.array(empty, pa.string()), "tei_xml": pa.array([""] * len(empty), pa.string())})))
