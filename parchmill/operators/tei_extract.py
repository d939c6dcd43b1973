"""From a checked document to one flat record of what needs the order of its tree.

Everything that a column expression can decide later (preferences, fallbacks,
distinct values, dates, identifiers, ordinals) is left as arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from ..plans.schema import ALL, Members
from .tei_schema import Checked, Element, check, check_quickly, read_leniently
from .xml_reader import SPACE, parse_tree

#: Only what collapsing changes: a single blank stays.
_RUN = re.compile(f"[{SPACE}]{{2,}}|[{SPACE.replace(' ', '')}]")


def normal(text: str | None) -> str | None:
    """White space collapsed and trimmed; null for what is then empty."""
    if text is None:
        return None
    return _RUN.sub(" ", text).strip(" ") or None


def _joined(parts: list[str | None]) -> str | None:
    return normal(" ".join(p for p in parts if p is not None))


def inline_text(element: Element) -> str | None:
    """A sequence's text: its parts in order with a blank between; pointers and breaks give none, figures their caption."""
    parts: list[str | None] = []
    for name, item in element.items:
        if isinstance(item, str):
            parts.append(item)
        elif name == "formula":
            parts.append(normal(item.text))
        elif name == "figure":
            parts.append(figure_caption(item))
        elif name not in ("ptr", "lb", "pb"):
            parts.append(inline_text(item))
    return _joined(parts)


def figure_caption(figure: Element) -> str | None:
    return _joined([inline_text(x) for name in ("head", "figDesc", "p") for x in figure.many(name)])


def table_text(table: Element) -> str | None:
    """Cells apart by tabs and rows by line breaks, empty ones left out, then collapsed like any text."""
    rows = ["\t".join(t for t in map(inline_text, row.many("cell")) if t) for row in table.many("row")]
    return normal("\n".join(r for r in rows if r))


def list_items(element: Element) -> list[str]:
    return [t for t in map(inline_text, element.many("item")) if t]


def chunks(division: Element) -> list[str]:
    """Paragraphs, list items and nested divisions of a division, in order."""
    out: list[str] = []
    for name, item in division.items:
        if name == "p":
            text = inline_text(item)
            if text:
                out.append(text)
        elif name == "div":
            out += chunks(item)
        elif name == "list":
            out += list_items(item)
    return out


def sections(content: Element, once: bool = False, inside: bool = False) -> list[dict[str, Any]]:
    """Pre-order; a division gives its own paragraphs as one section, and its content is then walked like any other,
    so each of these paragraphs follows once more as a section without title (unless ``once``)."""
    out: list[dict[str, Any]] = []
    for name, item in content.items:
        if name == "p" and not (once and inside):
            text = inline_text(item)
            if text:
                out.append({"title": "", "text_chunks": [text]})
        elif name == "div":
            heads = (inline_text(x) for n, x in item.items if n == "head")
            title = next((t for t in heads if t), None)
            own = [t for t in (inline_text(x) for n, x in item.items if n == "p") if t]
            if title or own:
                out.append({"title": title or "", "text_chunks": own})
            out += sections(item, once, True)
    return out


def _typed(element: Element) -> dict[str, Any]:
    return {"type": element.get("type"), "level": element.get("level"), "text": element.text}


Makers = dict[str, Callable[[Any, Members], Any]]


def _made(element: Any, wanted: Members, makers: Makers) -> dict[str, Any]:
    return {name: makers[name](element, inner) for name, inner in wanted.items()}


def _imprint(monogr: Element, name: str) -> list[Element]:
    imprint = monogr.one("imprint")
    return imprint.many(name) if imprint else []


#: ``d`` is the author with its first person, if it has one.
_AUTHOR: Makers = {
    "forenames": lambda d, _: [_typed(f) for f in d[1].many("forename")] if d[1] else [],
    "surnames": lambda d, _: [s.text for s in d[1].many("surname")] if d[1] else [],
    "affiliations": lambda d, _: [
        {
            "orgs": [_typed(o) for o in a.many("orgName")],
            "settlements": [s.text for x in a.many("address") for s in x.many("settlement")],
            "countries": [c.text for x in a.many("address") for c in x.many("country")],
        }
        for a in d[0].many("affiliation")
    ],
}


def _authors(element: Element, wanted: Members) -> list[dict[str, Any]]:
    return [_made((a, a.one("persName")), wanted, _AUTHOR) for a in element.many("author")]


_WORK: Makers = {
    "titles": lambda e, _: [_typed(t) for t in e.many("title")],
    "authors": _authors,
    "idnos": lambda e, _: [_typed(i) for i in e.many("idno")],
}
_MONOGR: Makers = _WORK | {
    "publishers": lambda m, _: [p.text for p in _imprint(m, "publisher")],
    "dates": lambda m, _: [{"when": d.get("when"), "text": d.text} for d in _imprint(m, "date")],
    "scopes": lambda m, _: [{"unit": s.get("unit"), "from": s.get("from"), "to": s.get("to"), "text": s.text} for s in _imprint(m, "biblScope")],
}
_BIBL: Makers = {
    "id": lambda b, _: None,
    "analytic": lambda b, wanted: _made(a, wanted, _WORK) if (a := b.one("analytic")) else None,
    "monogrs": lambda b, wanted: [_made(m, wanted, _MONOGR) for m in b.many("monogr")],
    "series_idnos": lambda b, _: [_typed(i) for i in s.many("idno")] if (s := b.one("series")) else [],
    "idnos": lambda b, _: [_typed(i) for i in b.many("idno")],
}


def _bibl(bibl: Element, wanted: Members) -> dict[str, Any]:
    return _made(bibl, wanted, _BIBL)


def _through_divs(content: Element, wanted: str) -> list[Element]:
    out: list[Element] = []
    for name, item in content.items:
        if name == wanted:
            out.append(item)
        elif name == "div":
            out += _through_divs(item, wanted)
    return out


def _figure(f: Element) -> dict[str, Any]:
    return {"id": None, "labels": [inline_text(x) for x in f.many("label")], "caption": figure_caption(f)}


def _table(t: Element) -> dict[str, Any]:
    return {"id": None, "heads": [inline_text(x) for x in t.many("head")], "raw_content": table_text(t)}


def _lenient(flat: dict[str, Any], body: Element, back: Element, bibls: list[Element], wanted: Members) -> dict[str, Any]:
    """The same record with ids, every paragraph once, and tables lifted out of the figures that hold them."""
    figures, tables = [], []
    for part in (body, back):
        for f in _through_divs(part, "figure"):
            held = f.many("table")
            if held or f.get("type") == "table":
                tables.append({"id": f.get("xml:id"), "heads": [figure_caption(f), *(inline_text(x) for t in held for x in t.many("head"))], "raw_content": _joined([table_text(t) for t in held])})
            else:
                figures.append(_figure(f) | {"id": f.get("xml:id")})
        tables += [_table(t) | {"id": t.get("xml:id")} for t in _through_divs(part, "table")]
    references = [_bibl(b, wanted["references"]) | {"id": b.get("xml:id")} for b in bibls] if "references" in wanted else []
    read = {"sections": sections(body, once=True), "figures": figures, "tables": tables, "references": references}
    return flat | {name: value for name, value in read.items() if name in wanted}


class _Parts:
    """The places of a checked document that its flat record is made from."""

    def __init__(self, tei: Element | Checked) -> None:
        self.tei, self.header = tei, tei.one("teiHeader")

    def stated(self, name: str) -> Element:
        """A part of the file's description that every document has."""
        return self.header.one("fileDesc").one(name)

    def profile(self, name: str) -> Element | None:
        profile = self.header.one("profileDesc")
        return profile.one(name) if profile else None

    def text(self, name: str) -> Element:
        text = self.tei.one("text")
        return (text.one(name) if text else None) or Element({})

    def both(self, name: str) -> list[Element]:
        return _through_divs(self.text("body"), name) + _through_divs(self.text("back"), name)

    def listed(self) -> list[Element]:
        return [b for x in _through_divs(self.text("back"), "listBibl") for b in x.many("biblStruct")]


def _abstract(d: _Parts) -> list[str | None]:
    abstract = d.profile("abstract")
    return [*map(inline_text, abstract.many("p")), *(c for x in abstract.many("div") for c in chunks(x))] if abstract else []


def _keywords(d: _Parts) -> list[dict[str, Any]]:
    subjects = d.profile("textClass")
    return [{"terms": [t.text for t in k.many("term")], "text": k.text, "items": [i for x in k.many("list") for i in list_items(x)]} for k in (subjects.many("keywords") if subjects else [])]


_FLAT: Makers = {
    "titles": lambda d, _: [_typed(t) for t in d.stated("titleStmt").many("title")],
    "authors": lambda d, wanted: _authors(d.stated("titleStmt"), wanted),
    "funders": lambda d, _: [[*(o.text for o in f.many("orgName")), f.text] for f in d.stated("titleStmt").many("funder")],
    "publishers": lambda d, _: [p.text for p in d.stated("publicationStmt").many("publisher")],
    "bibl": lambda d, wanted: _bibl(b, wanted) if (b := d.stated("sourceDesc").one("biblStruct")) else None,
    "abstract": lambda d, _: _abstract(d),
    "keywords": lambda d, _: _keywords(d),
    "funding_orgs": lambda d, _: [[*(n.text for n in o.many("orgName")), *(i.text for i in o.many("idno"))] for x in _through_divs(d.text("back"), "listOrg") if x.get("type") == "funding" for o in x.many("org")],
    "acknowledgements": lambda d, _: [c for name, x in d.text("back").items if name == "div" and x.get("type") == "acknowledgement" for c in chunks(x)],
    "sections": lambda d, _: sections(d.text("body")),
    "figures": lambda d, _: [_figure(f) for f in d.both("figure")],
    "tables": lambda d, _: [_table(t) for t in d.both("table")],
    "references": lambda d, wanted: [_bibl(b, wanted) for b in d.listed()],
}


def flat_document(xml: str, mode: str = "compat", wanted: Members = ALL) -> dict[str, Any]:
    """The flat record of a document; raises a ``ValueError`` that says what is wrong with it.

    ``compat`` is strict and keeps every peculiarity of the projection; ``lenient`` takes what it can read.
    The whole document is checked in either case; of the record only the ``wanted`` members are made.
    """
    if mode not in ("compat", "lenient"):
        raise ValueError(f"unknown mode {mode!r}")
    tei = read_leniently(parse_tree(xml)) if mode == "lenient" else check_quickly(xml) or check(parse_tree(xml))
    parts = _Parts(tei)
    flat = _made(parts, wanted, _FLAT)
    return flat if mode == "compat" else _lenient(flat, parts.text("body"), parts.text("back"), parts.listed(), wanted)
