"""``python -m parchmill INPUT TEI_DIR JSON_DIR``: PDFs to TEI text and papers; exit status 1 if any failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.ingest import ingest
from .sources.discovery import InvalidInput
from .sources.extraction import MAX_CONCURRENT, HttpExtractor
from .sources.sinks import error_lines


def main(argv: list[str] | None = None, extractor=None) -> int:
    p = argparse.ArgumentParser(prog="parchmill", description=__doc__)
    p.add_argument("source", help="a PDF file, or a folder of them")
    p.add_argument("tei_dir")
    p.add_argument("json_dir")
    p.add_argument("--tables", help="folder of the Parquet tables; default: TEI_DIR/_tables")
    p.add_argument("--service", default="http://localhost:8070", help="address of the extraction service")
    p.add_argument("--concurrent", type=int, default=MAX_CONCURRENT, help="calls to the service at one time")
    p.add_argument("--progress", action=argparse.BooleanOptionalAction, default=sys.stderr.isatty(), help="draw a progress line; default: on a terminal")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("parchmill").getOrCreate()
    try:
        run = ingest(spark, args.source, args.tei_dir, args.json_dir, args.tables or f"{args.tei_dir}/_tables", extractor or HttpExtractor(args.service), args.concurrent, args.progress)
    except InvalidInput as e:
        print(e, file=sys.stderr)
        return 1
    for row in error_lines(run.status).toLocalIterator():
        print(row["line"], file=sys.stderr)
    total = run.summary.first()
    print(total["line"], file=sys.stderr)
    return int(total["failed"])


if __name__ == "__main__":
    sys.exit(main())
