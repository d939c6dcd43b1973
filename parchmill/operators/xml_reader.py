"""A lenient XML tokenizer that yields a plain tree.

It accepts what a strict XML 1.0 parser rejects and the document rules allow:
control characters, unbound prefixes, ``<`` inside attribute values, anything
after the root. It rejects entities other than the five predefined and numeric
ones, text before the root, duplicate or unquoted attributes, mismatched end
tags and bare ampersands. Names lose their prefix; the encoding declaration is
ignored; comments vanish, so the text around them is one run.
"""

from __future__ import annotations

import re

PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
#: Unicode White_Space, as a class for :mod:`re` (``\\s`` also has U+001C..1F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NAME = r"[^\s<>/='\"]+"
_TAG = re.compile(rf"<(?:(/)({_NAME})\s*>|({_NAME})((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.DOTALL)
_ATTRIBUTE = re.compile(rf"\s*({_NAME})\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.DOTALL)
_REFERENCE = re.compile(r"&([^;]*)(;?)", re.DOTALL)
_BLANK = re.compile(rf"[{SPACE}]*\Z")


class XmlError(ValueError):
    """The document cannot be read."""


class Node:
    """An element: local name, attributes, children (nodes and merged text runs)."""

    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes = name, attributes
        self.children: list[Node | str] = []


def blank(text: str) -> bool:
    return _BLANK.match(text) is not None


def local(name: str) -> str:
    return name.rpartition(":")[2]


def _resolve(match: re.Match[str]) -> str:
    name, closed = match.groups()
    if not closed:
        raise XmlError("ill-formed document: entity or character reference not closed: `;` not found before end of input")
    if name in PREDEFINED:
        return PREDEFINED[name]
    if name.startswith("#"):
        try:
            code = int(name[2:], 16) if name[1:2] == "x" else int(name[1:])
            if code and not 0xD800 <= code <= 0xDFFF and name.isascii() and "_" not in name and "+" not in name:
                return chr(code)
        except (ValueError, OverflowError):
            pass
        raise XmlError(f"invalid character reference `{name}`")
    raise XmlError(f"unrecognized entity `{name}`")


def unescape(text: str) -> str:
    return _REFERENCE.sub(_resolve, text) if "&" in text else text


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    at = 0
    while at < len(source):
        if source[at:].isspace():
            break
        m = _ATTRIBUTE.match(source, at)
        if not m:
            raise XmlError(f"error while parsing attribute: {source[at:].strip()[:40]!r} is not name=\"value\"")
        name, double, single = m.groups()
        if name in found:
            raise XmlError(f"error while parsing attribute: duplicated attribute `{name}`")
        found[name] = unescape(double if double is not None else single)
        at = m.end()
    return found


def _doctype_end(source: str, at: int) -> int:
    depth = 0
    quote = ""
    for k in range(at, len(source)):
        c = source[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and depth:
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
        elif c == ">" and depth <= 0:
            return k + 1
    raise XmlError("syntax error: DOCTYPE not closed")


def parse_tree(source: str) -> Node:
    """The root element of ``source``; raises :class:`XmlError`."""
    at = 1 if source.startswith("\ufeff") else 0
    open_: list[tuple[str, Node]] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            open_[-1][1].children.append("".join(run))
            run.clear()

    size = len(source)
    while at < size:
        if source[at] != "<":
            end = source.find("<", at)
            end = size if end < 0 else end
            text = unescape(source[at:end])
            if open_:
                run.append(text)
            elif not blank(text):
                raise XmlError("invalid type: text before the document element")
            at = end
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            if end < 0:
                raise XmlError("syntax error: comment not closed")
            at = end + 3
        elif source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            if end < 0:
                raise XmlError("syntax error: CDATA not closed")
            if not open_:
                raise XmlError("invalid type: text before the document element")
            run.append(source[at + 9 : end])
            at = end + 3
        elif source.startswith("<?", at):
            end = source.find("?>", at)
            if end < 0:
                raise XmlError("syntax error: processing instruction not closed")
            at = end + 2
        elif source[at : at + 9].upper() == "<!DOCTYPE":
            at = _doctype_end(source, at + 9)
        else:
            m = _TAG.match(source, at)
            if not m:
                raise XmlError("syntax error: tag not closed: `>` not found before end of input" if ">" not in source[at:] else "syntax error: not a tag")
            _, end_name, name, rest = m.groups()
            at = m.end()
            if end_name is not None:
                if not open_ or open_[-1][0] != end_name:
                    raise XmlError(f"ill-formed document: expected `</{open_[-1][0] if open_ else ''}>`, but `</{end_name}>` was found")
                flush()
                _, node = open_.pop()
                if not open_:
                    return node
                continue
            if open_:
                flush()
            closed = rest.endswith("/")
            node = Node(local(name), {k.rpartition(":")[2] if k.startswith("xmlns:") else k: v for k, v in _attributes(rest[:-1] if closed else rest).items()})
            if open_:
                open_[-1][1].children.append(node)
            if not closed:
                open_.append((name, node))
            elif not open_:
                return node
    raise XmlError(f"ill-formed document: `</{open_[-1][0]}>` not found before end of input" if open_ else "unexpected `Event::Eof`")
