"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case last extension, null for none; a name that only begins with a dot has none."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)), F.lit(""))


def is_pdf(path: Column) -> Column:
    return F.coalesce(extension(path) == "pdf", F.lit(False))


def file_stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_tei_xml(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(r"[^/]\.tei\.xml$"), F.lit(False))


def tei_path(directory: str | Column, stem: Column) -> Column:
    base = F.lit(directory) if isinstance(directory, str) else directory
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), F.concat(stem, F.lit(".tei.xml")))


def json_path(directory: str | Column, path: Column) -> Column:
    """The name's last extension becomes ``json``: ``a.tei.xml`` gives ``a.tei.json``; without a name ``paper.tei.json``."""
    base = F.lit(directory) if isinstance(directory, str) else directory
    name = F.coalesce(F.nullif(file_name(path), F.lit("")), F.lit("paper.tei.xml"))
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), F.concat(file_stem(name), F.lit(".json")))
