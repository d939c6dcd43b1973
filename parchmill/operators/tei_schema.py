"""The element schema of TEI documents and the strict reading of a tree by it.

A *record* has named children: ``1`` required, ``?`` at most one, ``*`` any
number but in one unbroken run; children it does not know are skipped with
all they hold. A record may take one run of text. A *sequence* takes any
number of the children it knows, and text, in any order; an unknown child is
an error. Blank text never counts. Everything known is checked, also what no
projection reads.
"""

from __future__ import annotations

import re
from typing import NamedTuple
from xml.etree import ElementTree

from .xml_reader import Node, blank


class SchemaError(ValueError):
    """The document breaks the schema."""


class Record(NamedTuple):
    fields: dict[str, tuple[str, str]]  # child -> (type, multiplicity)
    text: bool = False


class Sequence(NamedTuple):
    variants: dict[str, str]


class Element:
    """A checked element: ``one``/``many`` give a record's children, ``items`` a sequence's (name, Element) and ("$text", str)."""

    __slots__ = ("attributes", "fields", "items", "text")

    def __init__(self, attributes: dict[str, str]) -> None:
        self.attributes = attributes
        self.fields: dict[str, list[Element]] = {}
        self.items: list[tuple[str, Element | str]] = []
        self.text: str | None = None

    def many(self, name: str) -> list[Element]:
        return self.fields.get(name, [])

    def one(self, name: str) -> Element | None:
        got = self.fields.get(name)
        return got[0] if got else None

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)


def _record(spec: str = "", text: bool = False) -> Record:
    """``"title:Title* idno"``: type and multiplicity after the name; a bare name is an optional text leaf list."""
    fields = {}
    for word in spec.split():
        name, _, kind = word.partition(":")
        kind = kind or "Leaf*"
        fields[name] = (kind.rstrip("1?*"), kind[-1])
    return Record(fields, text)


_INLINE = Sequence({"p": "Inlines", "ref": "Inlines", "ptr": "Empty", "rs": "Inlines", "hi": "Inlines", "lb": "Empty", "pb": "Empty", "note": "Inlines", "formula": "Leaf", "figure": "Figure"})
_BLOCK = Sequence(
    {"div": "Blocks", "p": "Inlines", "head": "Inlines", "list": "List", "listBibl": "ListBibl", "listOrg": "ListOrg", "figure": "Figure", "table": "Table", "note": "Inlines", "ref": "Inlines", "formula": "Leaf"}
)

TYPES: dict[str, Record | Sequence] = {
    "Leaf": _record(text=True),
    "Empty": _record(),
    "Inlines": _INLINE,
    "Blocks": _BLOCK,
    "Tei": _record("teiHeader:Header1 text:Text? TEI:Tei*"),
    "Text": _record("front:Blocks? body:Blocks? back:Blocks?"),
    "Header": _record("fileDesc:FileDesc1 encodingDesc:EncodingDesc? profileDesc:ProfileDesc? revisionDesc:RevisionDesc?"),
    "FileDesc": _record("titleStmt:TitleStmt1 editionStmt:EditionStmt? extent:Leaf? publicationStmt:PublicationStmt1 seriesStmt:SeriesStmt? notesStmt:NotesStmt? sourceDesc:SourceDesc1"),
    "TitleStmt": _record("title author:Author* editor:Author* sponsor:Organization* funder:Organization* principal:Organization* respStmt:RespStmt*"),
    "Organization": _record("orgName", text=True),
    "RespStmt": _record("resp name persName:PersName* orgName"),
    "EditionStmt": _record("edition respStmt:RespStmt*"),
    "PublicationStmt": _record("publisher distributor:Organization* authority:Organization* pubPlace address:Address* idno availability:Availability? date p:Inlines*"),
    "Availability": _record("licence p:Inlines*"),
    "SeriesStmt": _record("title idno respStmt:RespStmt*"),
    "NotesStmt": _record("note"),
    "SourceDesc": _record("biblStruct:BiblStruct* listBibl:ListBibl* bibl p:Inlines*"),
    "EncodingDesc": _record("appInfo:AppInfo? projectDesc:Description? samplingDecl:Description? editorialDecl:Description?"),
    "AppInfo": _record("application:Application*"),
    "Application": _record("desc label ref:Inlines*"),
    "Description": _record("p:Inlines*"),
    "ProfileDesc": _record("abstract:Abstract? textClass:TextClass? langUsage:LangUsage?"),
    "Abstract": _record("div:Blocks* p:Inlines*"),
    "TextClass": _record("keywords:Keywords* classCode"),
    "Keywords": _record("term list:List*", text=True),
    "LangUsage": _record("language"),
    "RevisionDesc": _record("change list:List*"),
    "BiblStruct": _record("analytic:Analytic? monogr:Monogr* series:Series? idno ptr:Empty* note"),
    "Analytic": _record("title author:Author* editor:Author* idno ptr:Empty*"),
    "Monogr": _record("title author:Author* editor:Author* idno ptr:Empty* imprint:Imprint?"),
    "Series": _record("title idno imprint:Imprint?"),
    "Imprint": _record("publisher pubPlace date biblScope"),
    "Author": _record("persName:PersName* orgName email idno affiliation:Affiliation*", text=True),
    "PersName": _record("forename surname genName addName roleName", text=True),
    "Affiliation": _record("orgName address:Address? note", text=True),
    "Address": _record("addrLine settlement region postCode country"),
    "List": _record("head:Inlines* item:Inlines*"),
    "ListBibl": _record("head:Inlines* biblStruct:BiblStruct*"),
    "ListOrg": _record("org:Org*"),
    "Org": _record("idno orgName"),
    "Figure": _record("head:Inlines* label:Inlines* figDesc:Inlines* graphic:Empty* p:Inlines*"),
    "Table": _record("head:Inlines* row:Row*"),
    "Row": _record("cell:Inlines*"),
}


def read_leniently(node: Node, kind: str = "Tei") -> Element:
    """The node read as ``kind`` as far as it goes: unknown children are skipped, repeats may stand apart, text runs are
    joined, of repeated single children the first counts, missing ones are empty, and figures may hold tables."""
    spec = TYPES[kind]
    out = Element(node.attributes)
    if isinstance(spec, Sequence):
        for child in node.children:
            if isinstance(child, str):
                if not blank(child):
                    out.items.append(("$text", child))
            elif child.name in spec.variants:
                out.items.append((child.name, read_leniently(child, spec.variants[child.name])))
        return out
    fields = {**spec.fields, "table": ("Table", "*")} if kind == "Figure" else spec.fields
    for child in node.children:
        if isinstance(child, str):
            if spec.text and not blank(child):
                out.text = child if out.text is None else f"{out.text} {child}"
        elif child.name in fields and (fields[child.name][1] == "*" or child.name not in out.fields):
            out.fields.setdefault(child.name, []).append(read_leniently(child, fields[child.name][0]))
    for name, (inner, times) in fields.items():
        if times == "1" and name not in out.fields:
            out.fields[name] = [read_leniently(Node(name, {}), inner)]
    return out


def check(node: Node, kind: str = "Tei") -> Element:
    """The node read as ``kind``; raises :class:`SchemaError` for the first breach."""
    spec = TYPES[kind]
    out = Element(node.attributes)
    if isinstance(spec, Sequence):
        for child in node.children:
            if isinstance(child, str):
                if not blank(child):
                    out.items.append(("$text", child))
                continue
            variant = spec.variants.get(child.name)
            if variant is None:
                raise SchemaError(f"unknown variant `{child.name}`")
            out.items.append((child.name, check(child, variant)))
        return out
    last = None
    for child in node.children:
        if isinstance(child, str):
            if spec.text and not blank(child):
                if out.text is not None:
                    raise SchemaError("duplicate field `$text`")
                out.text = child
                last = "$text"
            continue
        field = spec.fields.get(child.name)
        if field is not None:
            kind_, times = field
            held = out.fields.get(child.name)
            if held is not None and (times != "*" or last != child.name):
                raise SchemaError(f"duplicate field `{child.name}`")
            out.fields.setdefault(child.name, []).append(check(child, kind_))
        last = child.name
    for name, (_, times) in spec.fields.items():
        if times == "1" and name not in out.fields:
            raise SchemaError(f"missing field `{name}`")
    return out


class _Unusual(Exception):
    """The quick reading cannot vouch for its result."""


#: What the C tokenizer treats otherwise than the document rules: line ends, document types, white space inside attribute
#: values, and namespace declarations that are read as attributes.
_TREATED_OTHERWISE = ("\r", "<!D", "<!d")
_BROKEN_VALUE = re.compile(r"=[ \t\n]*(?:\"[^\"<]*[\t\n]|'[^'<]*[\t\n])")
_READ_PREFIX = re.compile(r"xmlns:(?:type|level|when|unit|from|to|id)[ \t\n]*=")
#: Levels from which the recursive reading decides whether a document is nested too deeply.
_DEEP = 200


class _Plan:
    """A type ready for use: per local name, and per tag as the C parser gives it, of a child its plan, whether it may repeat, and its name."""

    __slots__ = ("names", "needed", "sequence", "tags", "text")


_TEI = "{http://www.tei-c.org/ns/1.0}"


def _plans() -> dict[str, _Plan]:
    plans = {kind: _Plan() for kind in TYPES}
    for kind, spec in TYPES.items():
        plan = plans[kind]
        plan.sequence = isinstance(spec, Sequence)
        plan.text = plan.sequence or spec.text
        plan.names = {n: (plans[t], True, n) for n, t in spec.variants.items()} if plan.sequence else {n: (plans[t], times == "*", n) for n, (t, times) in spec.fields.items()}
        plan.tags = plan.names | {_TEI + n: found for n, found in plan.names.items()}
        plan.needed = () if plan.sequence else tuple(n for n, (_, times) in spec.fields.items() if times == "1")
    return plans


_PLANS = _plans()


def _find(plan: _Plan, tag: str) -> tuple[_Plan, bool, str] | None:
    """What a plan knows of a tag of another namespace, by its local name."""
    return plan.names.get(tag.rpartition("}")[2])


class Checked:
    """An element of a checked tree: what :class:`Element` offers, read from the tree built in C only when it is asked for."""

    __slots__ = ("node",)

    def __init__(self, node: ElementTree.Element) -> None:
        self.node = node

    def many(self, name: str) -> list[Checked]:
        end = "}" + name
        return [Checked(c) for c in self.node if c.tag.endswith(end) or c.tag == name]

    def one(self, name: str) -> Checked | None:
        end = "}" + name
        for c in self.node:
            if c.tag.endswith(end) or c.tag == name:
                return Checked(c)
        return None

    def get(self, name: str) -> str | None:
        return self.node.get(name)

    @property
    def text(self) -> str | None:
        """The one run of text of a record that takes text."""
        text = self.node.text
        if text and not text.isspace():
            return text
        return next((c.tail for c in self.node if c.tail and not c.tail.isspace()), None)

    @property
    def items(self) -> list[tuple[str, Checked | str]]:
        """A sequence's children and runs of text."""
        out: list[tuple[str, Checked | str]] = []
        text = self.node.text
        if text and not text.isspace():
            out.append(("$text", text))
        for child in self.node:
            out.append((child.tag.rpartition("}")[2], type(self)(child)))
            if (text := child.tail) and not text.isspace():
                out.append(("$text", text))
        return out


class _InTei(Checked):
    """The same where all elements are of the TEI namespace: children are found by their tags, in C."""

    __slots__ = ()

    def many(self, name: str) -> list[Checked]:
        return [_InTei(c) for c in self.node.findall(_TEI + name)]

    def one(self, name: str) -> Checked | None:
        found = self.node.find(_TEI + name)
        return None if found is None else _InTei(found)


def _sound(node: ElementTree.Element, plan: _Plan, depth: int) -> None:
    """Raises for a tree that :func:`check` may reject. A child without children can only lack some: it is not entered for less."""
    tags = plan.tags
    if plan.sequence:
        for child in node:
            found = tags.get(child.tag) or _find(plan, child.tag)
            if found is None or depth > _DEEP:
                raise _Unusual
            if len(child) or found[0].needed:
                _sound(child, found[0], depth + 1)
        return
    takes, met, last, run = plan.text, [], None, False
    if takes and (text := node.text) and not text.isspace():
        run = True
    for child in node:
        found = tags.get(child.tag) or _find(plan, child.tag)
        if found is None:
            last = None
        else:
            inner, many, name = found
            if depth > _DEEP:
                raise _Unusual
            if name != last:
                if name in met:
                    raise _Unusual
                met.append(name)
                last = name
            elif not many:
                raise _Unusual
            if len(child) or inner.needed:
                _sound(child, inner, depth + 1)
        if takes and (text := child.tail) and not text.isspace():
            if run:
                raise _Unusual
            run, last = True, None
    for need in plan.needed:
        if need not in met:
            raise _Unusual


def check_quickly(source: str) -> Checked | None:
    """What :func:`check` makes of a document, from a tree that is built in C.

    None for every document that the C parser or the schema rejects, or that
    holds what the parser reads differently: the lenient tokenizer decides
    those, and says what is wrong with them.
    """
    if any(x in source for x in _TREATED_OTHERWISE) or ("xmlns:" in source and _READ_PREFIX.search(source)):
        return None
    if ("\n" in source or "\t" in source) and _BROKEN_VALUE.search(source):
        return None
    parser = ElementTree.XMLParser(encoding="utf-8")
    try:
        parser.feed(source.encode())
        root = parser.close()
        _sound(root, _PLANS["Tei"], 0)
    except (_Unusual, ElementTree.ParseError, UnicodeEncodeError):
        return None
    # one declaration, on the root, and no prefix that needs none
    alone = root.tag == _TEI + "TEI" and source.count("xmlns") == 1 and "<xml:" not in source
    return _InTei(root) if alone else Checked(root)
