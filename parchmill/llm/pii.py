"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Each kind has an expression, a validator that a match must pass (Luhn for card
numbers, mod-97 for IBANs, octet, area and entropy rules elsewhere), a base
score, and context words that raise the score when one stands within
``CONTEXT_CHARS`` characters of the match. A span counts when its score reaches
``threshold``. Kinds that no checksum confirms and that other things look like
(plain digits, bare hexadecimal digests) begin below it, so only context lifts
them to it. Overlapping spans: the higher score wins, then the longer span,
then the earlier one.

Defined cases: a null or empty text has no spans; a whole text is searched,
whatever its length; equal values in one text are separate spans; rows that
repeat a document give their spans once per row; a null doc_id stays null; no row gives an empty result
with the full schema.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, slices

CONTEXT_CHARS = 40
THRESHOLD = 0.5

SPAN_SCHEMA = "doc_id bigint, kind string, start_char int, end_char int, value string, score double"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _card(value: str) -> float:
    digits = re.sub("[ -]", "", value)
    return 0.7 if 13 <= len(digits) <= 19 and len(set(digits)) > 1 and digits[0] in "23456" and luhn(digits) else 0.0


#: Characters of an IBAN by country; elsewhere 15 to 34.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _iban(value: str) -> float:
    bare = value.replace(" ", "")
    return 0.9 if (len(bare) == IBAN_LENGTHS.get(bare[:2], len(bare))) and 15 <= len(bare) <= 34 and mod97(bare) else 0.0


def _ip(value: str) -> float:
    if ":" in value:
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return 0.0
        return 0.6 if sum(map(bool, value.split(":"))) >= 3 else 0.0
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return 0.0
    return 0.6 if int(parts[0]) else 0.0


def _ssn(value: str) -> float:
    area, group, serial = value.split("-")
    return 0.6 if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else 0.0


#: French pairs, German area codes, ten American digits.
_NATIONAL = re.compile(r"0[0-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{6,8}|[2-9][0-9]{2}[2-9][0-9]{6}")


def _phone(value: str) -> float:
    digits = re.sub("[^0-9]", "", value)
    if not 10 <= len(digits) <= 15 or len(set(digits)) < 3:
        return 0.0
    if value.startswith("+") or "(" in value:
        return 0.6
    return 0.4  # plain digits otherwise, so they need a context word


def _email(value: str) -> float:
    user, _, host = value.rpartition("@")
    bad = user.startswith(".") or user.endswith(".") or ".." in value or any(p.startswith("-") or p.endswith("-") or not p for p in host.split("."))
    return 0.0 if bad else 0.9


def _dense(body: str) -> bool:
    entropy = -sum(n / len(body) * math.log2(n / len(body)) for n in Counter(body).values())
    return bool(entropy > 3.0 and re.search("[0-9]", body) and re.search("[A-Za-z]", body))


def _secret(value: str) -> float:
    if re.fullmatch("[0-9a-fA-F]+", value):
        return 0.4 if _dense(value) else 0.0  # a digest or a revision looks the same
    # the last part, or all parts where they hold several digits
    whole = re.sub("[_-]", "", re.split("[_-]", value, maxsplit=1)[-1])
    return 0.55 if _dense(value.split("_")[-1]) or (len(re.findall("[0-9]", whole)) >= 4 and _dense(whole)) else 0.0


class Kind(NamedTuple):
    name: str
    pattern: str
    score: Callable[[str], float]
    context: str
    #: What a context word adds.
    lift: float = 0.2
    #: Whether a match that the validator rejects is tried without its last groups.
    shorter: bool = False


KINDS = (
    Kind("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])", _email, r"e-?mail|mail|contact|correo|courriel", 0.1),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban, r"iban|account|konto|compte|cuenta", 0.1, True),
    Kind("card", r"(?<![0-9A-Za-z.+-])[2-6][0-9]{3}[ -]?(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z]|[.-][0-9])", _card, r"card|visa|master|credit|kredit|carte|tarjeta"),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _ssn, r"ssn|social|security|tax"),
    Kind("phone", r"(?<![0-9A-Za-z.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z.+-])(?:\+[1-9](?:[ .-]?[0-9]){9,14}|" + _NATIONAL.pattern + r")(?![0-9A-Za-z]|[.-][0-9])", _phone, r"phone|tel|call|fax|mobile|handy|tél|llama"),
    Kind("ip", r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])", _ip, r"\bip\b|host|server|address|adresse"),
    Kind("secret", r"(?<![0-9A-Za-z_-])(?:(?:sk|pk|ghp|gho|xox[a-z])[_-][A-Za-z0-9_-]{15,254}[A-Za-z0-9_]|AKIA[0-9A-Z]{16}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z_-])", _secret, r"token|key|secret|passw|auth|bearer"),
)
_COMPILED = [(k, re.compile(k.pattern), re.compile(k.context, re.IGNORECASE)) for k in KINDS]


def _matches(kind: Kind, pattern: re.Pattern[str], text: str) -> Iterator[tuple[int, str, float]]:
    """Place, value and base score of what the validator confirms."""
    at = 0
    while m := pattern.search(text, at):
        a, value = m.start(), m.group()
        at = a + 1 if kind.shorter else m.end()
        score = kind.score(value)
        while kind.shorter and not score and " " in value:
            value = value.rsplit(" ", 1)[0]
            score = kind.score(value)
        if score:
            at = a + len(value)
            yield a, value, score


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str, float]]:
    """``(kind, start, end, value, score)`` of a text, in order and without overlaps; positions count characters."""
    if not text:
        return []
    found = []
    for kind, pattern, context in _COMPILED:
        for a, value, score in _matches(kind, pattern, text):
            b = a + len(value)
            if context.search(text, max(0, a - CONTEXT_CHARS), a) or context.search(text, b, b + CONTEXT_CHARS):
                score = min(1.0, score + kind.lift)
            if score >= threshold:
                found.append((kind.name, a, b, value, round(score, 4)))
    found.sort(key=lambda s: (-s[4], s[1] - s[2], s[1]))
    kept: list[tuple[str, int, int, str, float]] = []
    if len(found) > 1:
        taken = bytearray(len(text))
        for s in found:
            if not any(taken[s[1] : s[2]]):
                taken[s[1] : s[2]] = b"\1" * (s[2] - s[1])
                kept.append(s)
        return sorted(kept, key=lambda s: s[1])
    return found


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span replaced by ``<KIND>``; null stays null."""
    spans = find_spans(text, threshold)
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, _, _ in spans:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _needed(text: Column) -> Column:
    """Every kind needs a digit, an ``@`` or a colon between hexadecimal letters, so other texts are not sent to Python."""
    return text.rlike("[0-9@]") | (text.contains(":") & text.rlike("[A-Fa-f:]:[A-Fa-f:]"))


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per confirmed span of ``docs(doc_id, text)``. No shuffle: texts with no digit and no ``@`` stay in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(d, *s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in find_spans(t, threshold)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "kind", "start_char", "end_char", "value", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(_needed(F.col("text"))).mapInArrow(run, SPAN_SCHEMA)


def redacted(text: Column, threshold: float = THRESHOLD) -> Column:
    """``text`` with its personal data masked; only texts that can hold any are sent to Python."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([redact(v, threshold) for v in values.to_pylist()], pa.string())

    return F.when(_needed(text), run(F.when(_needed(text), text))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(read(spark, sf_dir, "documents"))
