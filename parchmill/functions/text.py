"""Text functions as column expressions: white space, preferred titles, page ranges, ordered distinct values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_ODD = r"\t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of Unicode White_Space that collapsing changes: a single blank stays. Named one by one they are found faster than by
#: their property.
_RUN = f"[{_ODD}][{_ODD} ]*| [{_ODD} ]+"


def normalize_ws(text: Column) -> Column:
    """Unicode white space collapsed to single blanks and trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


def normalized_opt(text: Column) -> Column:
    """:func:`normalize_ws`, null for what is then empty."""
    return F.nullif(normalize_ws(text), F.lit(""))


def present(texts: Column) -> Column:
    """The texts of an array, normalised, without those that are then empty."""
    return F.array_compact(F.transform(texts, normalized_opt))


def joined(texts: Column) -> Column:
    """Non-null texts of an array joined by blanks and normalised; null for nothing."""
    return normalized_opt(F.array_join(F.array_compact(texts), " "))


def unique(texts: Column) -> Column:
    """Non-null values in order of their first occurrence."""
    return F.array_distinct(F.array_compact(texts))


def first(values: Column) -> Column:
    """First element, null for an empty or null array."""
    return F.get(values, F.lit(0))


def first_title(titles: Column) -> Column:
    """Text of the first title of type ``main``, else of the first title; a blank one gives null and no other is tried."""
    main = F.filter(titles, lambda t: t["type"] == "main")
    return normalized_opt(F.coalesce(first(main), first(titles))["text"])


def journal_title(titles: Column) -> Column:
    """Text of the first title of level ``j``, else of the first title."""
    journal = F.filter(titles, lambda t: t["level"] == "j")
    return normalized_opt(F.coalesce(first(journal), first(titles))["text"])


def scope_text(scopes: Column, unit: str) -> Column:
    """``from-to`` of the first scope of this unit if it has both, else its text."""
    s = first(F.filter(scopes, lambda s: s["unit"] == unit))
    return normalized_opt(F.when(s["from"].isNotNull() & s["to"].isNotNull(), F.concat(s["from"], F.lit("-"), s["to"])).otherwise(s["text"]))


def identifier(idnos: Column, kind: str) -> Column:
    """First identifier of a kind (any ASCII case of its type) that is not blank."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    of_kind = F.filter(idnos, lambda i: F.translate(i["type"], letters, letters.upper()) == kind)
    return first(present(F.transform(of_kind, lambda i: i["text"])))
