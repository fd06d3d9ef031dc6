"""Scalar functions as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, known currencies and words for "no value".
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "MMM d, yyyy", "d MMM yyyy")
CURRENCIES = ("INR", "USD", "EUR", "GBP", "JPY", "AUD", "CAD", "SGD", "AED", "CNY", "₹", "$", "€", "£")
NUMBER = r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"


def fy_label(ts: Column) -> Column:
    """Financial year April to March, as 2023-24."""
    start = F.year(ts) - F.when(F.month(ts) < 4, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def fy_start(fy: Column) -> Column:
    return F.split(fy, "-")[0].cast("int")


def slugify(name: Column, default: str = "unknown-company") -> Column:
    """Lower case, letters and digits of any script kept, the rest as single hyphens."""
    s = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}_\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), r"-+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w.\-]", "_")


def plain_text(text: Column) -> Column:
    """Lower case letters, digits and &, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s&]", " "), r"\s+", " "))


def numeric_tokens(cell: Column) -> Column:
    """Tokens of a cell that are amounts or dashes; trailing punctuation is dropped."""
    tokens = F.transform(F.split(F.trim(cell), r"\s+"), lambda t: F.regexp_replace(t, r"[,.;:]+$", ""))
    return F.filter(tokens, lambda t: t.rlike(r"^(\(?[-–—]?\d[\d,.]*\)?%?|[-–—])$"))


def parse_amount(text: Column) -> Column:
    """An amount with thousands separators; parentheses or a leading minus make it negative; null if it is none."""
    bare = F.regexp_replace(F.trim(text), r"[,₹$€£\s]", "")
    inner = F.regexp_replace(bare, r"^\((.*)\)$", "$1")
    value = F.when(inner.rlike(NUMBER), inner.try_cast("double"))
    return F.when(bare.rlike(r"^\(.*\)$"), -value).otherwise(value)


def number_or_zero(text: Column) -> Column:
    """Null and empty count as 0, garbage as null."""
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(0.0)).otherwise(parse_amount(text))


def is_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).isNotNull()


def is_float(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | parse_amount(text).isNotNull()


def is_currency(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)).isin(*CURRENCIES) | text.rlike(r"^[A-Za-z]{1,4}$"), F.lit(False))


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by |, null as None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


def candidate_term(evidence: Column) -> Column:
    """The label part of an evidence text, or null if it is no usable term."""
    t = F.regexp_replace(evidence, r"(?i)\[page \d+\]", "")
    t = F.lower(F.regexp_replace(F.regexp_replace(F.split(t, r"\|")[0], r"^[\s:-]+|[\s:-]+$", ""), r"\s+", " "))
    return F.when(F.char_length(t).between(4, 80) & t.rlike("[a-z]{3,}"), t)


def pct_difference(a: Column, b: Column) -> Column:
    """|a - b| / |b|, 0 for b = 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.abs(a - b) / F.abs(F.nullif(b, F.lit(0.0))))


def hits(text: Column, words: list[str], lowered: bool = False) -> Column:
    """How many of the words are in the text (a word listed twice counts twice), which may be in lower case already."""
    low = text if lowered else F.lower(text)
    return sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))
