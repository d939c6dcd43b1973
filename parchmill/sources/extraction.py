"""Turning PDFs into TEI text through an extraction service.

The service is any callable ``(path, content) -> str`` that raises
:class:`ExtractionError`; :class:`HttpExtractor` posts to a server. Executors
read a file and call the service in one pass, so no content is shuffled; the
number of partitions bounds how many calls run at once.
"""

from __future__ import annotations

import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame

from .discovery import file_bytes

#: Calls to the service at one time.
MAX_CONCURRENT = 10
SCHEMA = "path string, stem string, tei_xml string, error_kind string, error_message string"

Extractor = Callable[[str, bytes], str]


class ExtractionError(Exception):
    kind = "extraction"


class UnsuccessfulResponse(ExtractionError):
    kind = "unsuccessful_response"

    def __init__(self, status: int, body: str) -> None:
        super().__init__(f"extraction service answered {status}: {body}")
        self.status, self.body = status, body


class RequestFailed(ExtractionError):
    kind = "request"


class HttpExtractor:
    """Posts a file as the multipart field ``input``."""

    def __init__(self, url: str = "http://localhost:8070", endpoint: str = "/api/processFulltextDocument", timeout: float | None = None) -> None:
        self.url, self.timeout = url.rstrip("/") + endpoint, timeout

    def __call__(self, path: str, content: bytes) -> str:
        mark = uuid.uuid4().hex
        name = path.rpartition("/")[2].replace('"', "%22")
        head = f'--{mark}\r\nContent-Disposition: form-data; name="input"; filename="{name}"\r\nContent-Type: application/pdf\r\n\r\n'
        body = head.encode() + content + f"\r\n--{mark}--\r\n".encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": f"multipart/form-data; boundary={mark}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            raise UnsuccessfulResponse(e.code, e.read().decode("utf-8", "replace")) from e
        except (urllib.error.URLError, OSError) as e:
            raise RequestFailed(f"request failed: {e}") from e


def extract(pdfs: DataFrame, extractor: Extractor, concurrent: int = MAX_CONCURRENT, done: Accumulator | None = None) -> DataFrame:
    """``path, stem, tei_xml`` or an error per row of ``pdfs(path, stem)``; one failure, of reading too, does not stop the others.

    ``concurrent`` is the number of tasks, and so of calls at one time; ``done`` counts finished documents.
    """

    def one(path: str, stem: str | None) -> tuple[str | None, ...]:
        try:
            content = file_bytes(path)
        except Exception as e:
            return path, stem, None, "read", f"failed to read PDF: {e}"
        try:
            return path, stem, extractor(path, content), None, None
        except ExtractionError as e:
            return path, stem, None, e.kind, str(e)
        except Exception as e:  # a task that breaks is a failed document
            return path, stem, None, "panic", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, stem in zip(batch.column("path").to_pylist(), batch.column("stem").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in one(path, stem)], names=["path", "stem", "tei_xml", "error_kind", "error_message"])
                if done is not None:
                    done.add(1)

    return pdfs.select("path", "stem").repartition(concurrent, "path").mapInArrow(run, SCHEMA)
