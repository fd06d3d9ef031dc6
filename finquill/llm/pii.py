"""Personal data: regular expressions propose spans, checks confirm, context scores.

Kinds.  The base kinds are ``email``, ``ip``, ``card`` and ``phone`` with the
patterns below, leftmost and non-overlapping per kind; a match that fails its
check (parts at most 255, Luhn with 14 to 19 digits, 10 to 15 digits) is dropped
and not retried.  ``iban`` (mod-97 and the length of known countries) and
``ssn`` (area, group and serial in range) are added ones.  Overlapping spans of
different kinds all stay.

Score.  Each kind has a prior; words near the span (CONTEXT_CHARS on either side)
that name the kind raise it and words that speak of examples, versions or
invoices lower it.  The score orders and filters spans for callers; base spans
stay whatever their score is.

The scans are linear in the length of a text: each pattern is entered only where a
match can begin, so long runs of digits or letters aren't tried at every start.

Edge cases: null and empty texts have no spans; offsets are code points, end
exclusive; null ids are kept; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
CONTEXT_CHARS = 40

# The contract's patterns, entered only where a match can begin.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile("[^0-9]")

# Lengths of IBANs by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24,
    "SI": 19, "SK": 24,
}

# Priors, and words that speak for a kind or against any.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "ssn": 0.6}
FOR = {
    "email": frozenset("email mail contact correo courriel kontakt write".split()),
    "ip": frozenset("ip host server address adresse login dirección".split()),
    "card": frozenset("card credit visa mastercard amex karte carte tarjeta pay".split()),
    "phone": frozenset("phone tel call mobile fax telefon téléphone teléfono".split()),
    "iban": frozenset("iban account bank konto compte cuenta".split()),
    "ssn": frozenset("ssn social security".split()),
}
AGAINST = frozenset("example test sample version invoice order isbn serial beispiel exemple ejemplo".split())
RAISE, LOWER = 0.2, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[n]
    return total % 10 == 0


def mod97(iban: str) -> bool:
    value = 0
    for c in iban[4:] + iban[:4]:
        value = (value * 10 + int(c) if c.isdigit() else value * 100 + ord(c) - 55) % 97
    return value == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ outwards, never before the last match's end."""
    out: list[tuple[int, int]] = []
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1  # no local part reaches over an @
        at = text.find("@", floor)
    return out


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTH.get(m[0][:2])
        end, seen = m.start(), 0
        while length and end < m.end() and seen < length:
            seen += text[end] != " "
            end += 1
        whole = end == m.end() or text[end] == " "
        if length and seen == length and whole and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = set(_WORD.findall(near.lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + RAISE * bool(words & FOR[kind]) - LOWER * bool(words & AGAINST))), 3)


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed in KINDS."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for k, search in enumerate((_ips, _cards, _phones, _ibans, _ssns), 1):
        found += [(s, k, e) for s, e in search(text)]
    found.sort()
    return [(s, e, KINDS[k], score(KINDS[k], text, s, e)) for s, k, e in found]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, score), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [[{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in find(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(_SPAN))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def spans_text(spans: Column) -> Column:
    """kind:start:end joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: str, least_score: float = 0.0) -> str:
    """The text with each span replaced by <kind>; of overlapping spans the first stays."""
    out, at = [], 0
    for s, e, kind, x in find(text):
        if s >= at and x >= least_score:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join(out) + text[at:]
