"""The types of parsed documents and of papers, as DDL."""

from __future__ import annotations

from typing import Any

#: Of a record of nested members those to be made, each with those of its own; nothing below a member means all of it.
Members = dict[str, "Members"]

_TYPED = "array<struct<type:string,level:string,text:string>>"
_AUTHORS_IN = [{"forenames": _TYPED, "surnames": "array<string>", "affiliations": f"array<struct<orgs:{_TYPED},settlements:array<string>,countries:array<string>>>"}]
_WORK: dict[str, Any] = {"titles": _TYPED, "authors": _AUTHORS_IN, "idnos": _TYPED}
_MONOGR = _WORK | {"publishers": "array<string>", "dates": "array<struct<when:string,text:string>>", "scopes": "array<struct<unit:string,from:string,to:string,text:string>>"}
_BIBL = {"id": "string", "analytic": _WORK, "monogrs": [_MONOGR], "series_idnos": _TYPED, "idnos": _TYPED}
_FLAT = {
    "titles": _TYPED, "authors": _AUTHORS_IN, "funders": "array<array<string>>", "publishers": "array<string>", "bibl": _BIBL, "abstract": "array<string>",
    "keywords": "array<struct<terms:array<string>,text:string,items:array<string>>>", "funding_orgs": "array<array<string>>", "acknowledgements": "array<string>",
    "sections": "array<struct<title:string,text_chunks:array<string>>>", "figures": "array<struct<id:string,labels:array<string>,caption:string>>",
    "tables": "array<struct<id:string,heads:array<string>,raw_content:string>>", "references": [_BIBL],
}


def _all(kind: Any) -> Members:
    kind = kind[0] if isinstance(kind, list) else kind
    return {name: _all(inner) for name, inner in kind.items()} if isinstance(kind, dict) else {}


#: Every member of the flat record.
ALL = _all(_FLAT)


def members(paths: tuple[str, ...]) -> Members:
    """The members at these paths with all that they hold, in order of declaration; all of the record for none."""
    if not paths:
        return ALL

    def below(kind: Any, inside: list[list[str]]) -> Members:
        if any(not p for p in inside):
            return _all(kind)
        kind = kind[0] if isinstance(kind, list) else kind
        unknown = {p[0] for p in inside} - (kind.keys() if isinstance(kind, dict) else set())
        if unknown:
            raise ValueError(f"no such member: {sorted(unknown)}")
        return {name: below(inner, [p[1:] for p in inside if p[0] == name]) for name, inner in kind.items() if any(p[0] == name for p in inside)}

    return below(_FLAT, [p.split(".") for p in paths])


def _ddl(kind: Any, wanted: Members) -> str:
    if isinstance(kind, list):
        return f"array<{_ddl(kind[0], wanted)}>"
    return "struct<" + ",".join(f"{name}:{_ddl(kind[name], inner)}" for name, inner in wanted.items()) + ">" if isinstance(kind, dict) else kind


def flat_ddl(wanted: Members) -> str:
    """The type of what the parser returns, with ``error`` before the wanted members."""
    return "struct<error:string," + _ddl(_FLAT, wanted).removeprefix("struct<")


#: What the parser returns: see :func:`parchmill.operators.tei_extract.flat_document`.
FLAT = flat_ddl(ALL)

_AFFILIATION = "struct<laboratory:string,department:string,institution:string,settlement:string,country:string>"
AUTHOR = f"struct<first_name:string,middle_name:string,last_name:string,affiliations:array<{_AFFILIATION}>>"
IDENTIFIERS = "struct<doi:string,isbn:string,issn:string>"
BOX = "struct<page:bigint,x:float,y:float,width:float,height:float>"
#: One document. Lists are never null; every other member may be.
PAPER = (
    "struct<core:struct<title:string,abstract_text:string,keywords:array<string>,funding_statements:array<string>,acknowledgements:string>,"
    f"publication:struct<identifiers:{IDENTIFIERS},publisher:string,journal:string,date:struct<year:int,month:int,day:int>,volume:string,issue:string,pages:string>,"
    f"authors:array<{AUTHOR}>,"
    "content:struct<sections:array<struct<title:string,text_chunks:array<string>>>,"
    f"figures:array<struct<id:string,label:string,caption:string,bounding_boxes:array<{BOX}>>>,"
    f"tables:array<struct<id:string,label:string,caption:string,raw_content:string,bounding_boxes:array<{BOX}>>>,"
    f"references:array<struct<id:string,title:string,authors:array<{AUTHOR}>,journal:string,year:int,identifiers:{IDENTIFIERS}>>>,"
    f"extraction_data:struct<properties:struct<page_count:bigint,file_size:bigint>,bounding_boxes:array<{BOX}>>>"
)
