"""TEI text from columns, for round trips through the parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(out, F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _text(part: Column | str) -> Column:
    return F.lit(part) if isinstance(part, str) else part


def element(name: str, *parts: Column | str, **attributes: Column | str) -> Column:
    """``<name a="...">parts</name>``; text parts must be escaped, attribute columns are escaped here."""
    opened: list[Column] = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        opened += [F.lit(f' {key.rstrip("_")}="'), escape(_text(value)), F.lit('"')]
    return F.concat(*opened, F.lit(">"), *map(_text, parts), F.lit(f"</{name}>"))


def each(values: Column, make) -> Column:
    """The elements of an array made into XML, one after another."""
    return F.array_join(F.transform(values, make), "")


def tei(title: Column | str = "", publication: Column | str = "", source: Column | str = "", profile: Column | str = "", body: Column | str = "", back: Column | str = "") -> Column:
    header = element("teiHeader", element("fileDesc", element("titleStmt", title), element("publicationStmt", publication), element("sourceDesc", source)), element("profileDesc", profile))
    return element("TEI", header, element("text", element("body", body), element("back", back)), xmlns="http://www.tei-c.org/ns/1.0")
