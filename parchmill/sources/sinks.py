"""Writing TEI text, papers as JSON, and the run's log."""

from __future__ import annotations

import json
import os
import sys
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import json_path, tei_path


def paper_json(paper: Column) -> Column:
    """One line of JSON with explicit nulls and ``[]`` for empty lists, keys in order of declaration."""
    return F.to_json(paper, {"ignoreNullFields": "false"})


def pretty(line: str) -> str:
    """Indented by two, no final line break."""
    return json.dumps(json.loads(line), indent=2, ensure_ascii=False)


def write_file(path: str, body: str) -> None:
    """Puts a file where ``path`` says, on any file system; a retried task writes the same file anew, and no reader sees half of one."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    local = isinstance(store, fs.LocalFileSystem)
    part = f"{inner}.{uuid.uuid4().hex}.part" if local else inner  # an object becomes visible when it is whole
    with store.open_output_stream(part) as f:
        f.write(body.encode())
    if local:
        try:
            store.move(part, inner)
        except OSError:
            store.delete_file(part)
            raise


def _written(files: DataFrame, indented: bool) -> DataFrame:
    """Writes ``files(path, target, body)``; gives ``path, message`` of those that could not be written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad: list[tuple[str, str]] = []
            for path, target, body in zip(*(batch.column(c).to_pylist() for c in ("path", "target", "body")), strict=True):
                try:
                    write_file(target, pretty(body) if indented else body)
                except OSError as e:
                    bad.append((path, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([b[k] for b in bad], pa.string()) for k in (0, 1)], names=["path", "message"])

    return files.select("path", "target", "body").mapInArrow(run, "path string, message string")


def write_tei_files(docs: DataFrame, directory: str) -> DataFrame:
    """``<directory>/<stem>.tei.xml`` with the text as it came, for every row with text, once the result is read: the failures."""
    return _written(docs.where("tei_xml is not null").select("path", tei_path(directory, F.col("stem")).alias("target"), F.col("tei_xml").alias("body")), False)


def write_json_files(papers: DataFrame, directory: str, path: str = "tei_path") -> DataFrame:
    """One indented JSON file per paper, once the result is read: the failures. ``a.tei.xml`` becomes ``a.tei.json``."""
    return _written(papers.where("paper is not null").select("path", json_path(directory, F.col(path)).alias("target"), paper_json(F.col("paper")).alias("body")), True)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Parquet, overwritten; returns the table as written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Cells of a progress bar.
BAR_CELLS = 24


def progress_line(completed: Column, total: Column, running: Column, most: int, width: int = 120) -> Column:
    """``[###---] done/all | running now/most``; nothing to do counts as done, and a long line is cut with an ellipsis."""
    filled = F.when(total == 0, F.lit(BAR_CELLS)).otherwise(F.floor(completed * BAR_CELLS / F.nullif(total, F.lit(0)))).cast("int")
    counts = [x.cast("string") for x in (completed, total, running)]
    line = F.concat(F.lit("["), F.rpad(F.repeat(F.lit("#"), filled), BAR_CELLS, "-"), F.lit("] "), counts[0], F.lit("/"), counts[1], F.lit(" | running "), counts[2], F.lit(f"/{most}"))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 3), F.lit("..."))).otherwise(line)


def progress_text(completed: int, total: int, running: int, most: int, width: int = 120) -> str:
    """:func:`progress_line` for one run."""
    filled = completed * BAR_CELLS // total if total else BAR_CELLS
    line = f"[{'#' * filled}{'-' * (BAR_CELLS - filled)}] {completed}/{total} | running {running}/{most}"
    return line if len(line) <= width else line[: width - 3] + "..."


class Progress:
    """Redraws a line on a stream while a run goes on. ``done`` says how many documents have ended."""

    def __init__(self, done: Callable[[], int], total: int, most: int, stream=None, seconds: float = 0.5) -> None:
        self.done, self.total, self.most, self.stream, self.seconds = done, total, most, stream or sys.stderr, seconds
        self.over = threading.Event()

    def _draw(self) -> None:
        completed = min(self.done(), self.total)
        self.stream.write("\r\x1b[2K" + progress_text(completed, self.total, min(self.most, self.total - completed), self.most))
        self.stream.flush()

    def _run(self) -> None:
        self._draw()
        while not self.over.wait(self.seconds):
            self._draw()

    def __enter__(self) -> Progress:
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()
        self._draw()
        self.stream.write("\r\x1b[2K")
        self.stream.flush()


def collapse(message: Column) -> Column:
    return F.trim(F.regexp_replace(message, r"(?U)\s+", " "))


def error_lines(status: DataFrame) -> DataFrame:
    """``Error in <path>: <message>`` for each error, in order of the paths."""
    return status.where("failed").select("path", F.explode("errors").alias("message")).orderBy("path").select(F.concat(F.lit("Error in "), "path", F.lit(": "), collapse(F.col("message"))).alias("line"))


def summary(status: DataFrame) -> DataFrame:
    """``total, failure_count, failed, line`` of a run."""
    total, bad = F.count("*"), F.count_if("failed")
    line = F.concat(F.lit("Processed "), total, F.when(total == 1, " PDF: ").otherwise(" PDFs: "), total - bad, F.lit(" succeeded, "), bad, F.lit(" failed"))
    return status.agg(total.alias("total"), bad.alias("failure_count"), (bad > 0).alias("failed"), line.alias("line"))
