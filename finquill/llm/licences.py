"""Licence scans: identifier tags, notice phrases, and licence expressions.

One Aho-Corasick automaton runs over a text's words (A-Z in lower case; runs of a-z, 0-9 and all
above ASCII) and finds notice phrases and identifier tags.  What follows a tag on its line
is a licence expression: a shunting-yard parser brings it into postfix order (``with`` binds
tighter than ``and``, that tighter than ``or``; ``/`` is ``or``), which is then evaluated to the
labels it names and the level of duties of the best choice it leaves:

0 permissive, 1 duties for the file or library, 2 duties for the whole work, 3 restricted
(no commercial use, no changes, nothing granted) or unknown.  ``or`` takes the lower level of
its sides, ``and`` the higher, an exception after ``with`` brings 2 down to 1.

Every place of a base phrase counts.  Other notices that lie inside a longer match are left out.
An expression ends where no operator joins what follows; one that can't be parsed (an operator
without a side, a bracket too many) is marked as not valid, gives level 3, and its known
identifiers still give labels.  A general tag (``license:``) counts only if it names a known one.

Score: 1 - product of (1 - weight) over notices and expressions, each kind and label once; 0 without any.

Edge cases: null and empty texts have no words and no matches; places are words from 0; repeated
rows give repeated results, null ids are kept; very long texts need memory in proportion to
their length; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from finquill.llm.common import slices

# The phrases of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notices, by the words they are known by.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}

# What announces an expression; the general ones count only with a known identifier.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}

# Families of identifiers and their levels.
LEVELS = {
    0: "mit mit-0 apache bsd isc zlib bsl 0bsd cc0 cc-by unlicense wtfpl artistic python ncsa postgresql public-domain",
    1: "lgpl mpl epl cddl eupl osl",
    2: "gpl agpl cc-by-sa",
    3: "cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd sspl proprietary licenseref-proprietary",
}
LEVEL = {name: level for level, names in LEVELS.items() for name in names.split()}
RESTRICTED = 3
WEIGHT = {"notice": 0.7, "tag": 0.95}

_OPERATORS = {"or": 1, "/": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()/]|[a-z0-9][a-z0-9.+:_-]*")
_VERSION = re.compile(r"-v?[0-9].*$")
#: What is no word, as spaces; A-Z in lower case: table of ``bytes.translate``.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, table in (("notice", NOTICES), ("base", BASE), ("tag", TAGS)):
        for phrase, value in table.items():
            out.add_word(f" {phrase} ", (kind, value, phrase.count(" ") + 1))
    out.make_automaton()
    return out


AUTOMATON = _automaton()


def family(identifier: str) -> str:
    """``gpl-2.0-or-later`` and ``GPL-2.0+`` are ``gpl``; an unknown identifier is itself."""
    name = identifier.lower().rstrip("+")
    for suffix in ("-or-later", "-only"):
        name = name.removesuffix(suffix)
    if name in LEVEL:
        return name
    short = _VERSION.sub("", name)
    return short if short in LEVEL else name


def tokens_of(line: str) -> list[str]:
    """Tokens up to where nothing joins what follows."""
    out: list[str] = []
    operand = False  # the last token ends one
    depth = 0
    at = 0
    line = line.lower()
    while m := _TOKEN.search(line, at):
        token = m[0].rstrip(".:") if m[0] not in "()/" else m[0]
        if line[at : m.start()].strip(" \t") and out:  # another sign stands between
            break
        if operand and token != ")" and token not in _OPERATORS or token == ")" and not depth and operand:
            break
        depth += (token == "(") - (token == ")")
        out.append(token)
        operand = token == ")" or token not in _OPERATORS and token != "("
        at = m.end()
    while out and out[-1] in ("and", "or", "with", "/"):  # prose that goes on
        out.pop()
    return out


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if a side or a bracket is missing."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    for t in tokens:
        if t == "(":
            if operand:
                return None
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or not operand:
                return None
            held.pop()
        elif t in _OPERATORS:
            if not operand:
                return None
            while held and held[-1] != "(" and _OPERATORS[held[-1]] >= _OPERATORS[t]:
                out.append(held.pop())
            held.append(t)
            operand = False
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


@dataclass
class Expression:
    text: str
    valid: bool
    labels: set[str]
    level: int


def evaluate(tokens: list[str]) -> Expression:
    text, order = " ".join(tokens), postfix(tokens)
    named = {f for t in tokens if t not in _OPERATORS and t not in "()" and (f := family(t)) in LEVEL}
    if order is None:
        return Expression(text, False, named, RESTRICTED)
    stack: list[tuple[int, str]] = []
    for t in order:
        if t not in _OPERATORS:
            stack.append((LEVEL.get(family(t), RESTRICTED), t))
            continue
        (right, _), (left, name) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((1 if left == 2 else left, name))
        else:
            stack.append((max(left, right) if t == "and" else min(left, right), name))
    return Expression(text, True, named, stack[0][0])


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]  # (word, label) of every place of a base phrase
    spans: list[tuple[int, int, str, str]]  # (word, words, kind, label) of all else that was found
    expressions: list[Expression]

    @property
    def labels(self) -> set[str]:
        return {x for _, x in self.base} | {s[3] for s in self.spans}

    @property
    def score(self) -> float:
        rest = 1.0
        for kind, _ in {("notice", x) for _, x in self.base} | {(s[2], s[3]) for s in self.spans}:
            rest *= 1 - WEIGHT[kind]
        return 1 - rest


def scan(data: bytes | None) -> Scan:
    """All of a text in UTF-8."""
    words = (data or b"").translate(_WORDS).split()
    found: list[tuple[int, int, str, object]] = []
    text = f" {b' '.join(words).decode('utf-8')} "
    at = word = 0
    for end, (kind, value, n) in AUTOMATON.iter(text):
        word += text.count(" ", at, end)
        at = end
        found.append((word - n, n, kind, value))
    if not found:
        return Scan(len(words), [], [], [])
    base = [(w, label) for w, _, kind, label in found if kind == "base"]
    spans, expressions = [], []
    ends = [(w, w + n) for w, n, kind, _ in found if kind != "tag"]
    widest: dict[int, int] = {}
    for a, b in ends:
        widest[a] = max(widest.get(a, 0), b)
    reach, before = 0, {}
    for a in sorted(widest):  # how far matches that begin earlier reach
        before[a] = reach
        reach = max(reach, widest[a])
    for w, n, kind, label in found:
        if kind == "notice" and widest[w] == w + n and before[w] < w + n:
            spans.append((w, n, kind, label))
    tags = [x for x in found if x[2] == "tag"]
    if tags:
        own = data.decode("utf-8")
        wanted = {w + n - 1 for w, n, _, _ in tags}
        end_of = {k: m.end() for k, m in enumerate(_WORD.finditer(own)) if k in wanted}
        seen = -1
        for w, n, _, sure in sorted(tags, key=lambda x: (x[0], -x[1])):
            end = end_of[w + n - 1]
            if w <= seen or own[end : end + 1] != ":":
                continue
            seen = w + n - 1
            stop = own.find("\n", end)
            tokens = tokens_of(own[end + 1 : stop if stop >= 0 else len(own)])
            if not tokens:
                continue
            e = evaluate(tokens)
            if sure or e.labels:
                expressions.append(e)
                spans += [(w, n, "tag", label) for label in sorted(e.labels)]
    return Scan(len(words), base, spans, expressions)


SCHEMA = (
    "doc_id long, n_words long, base array<struct<word: long, label: string>>, "
    "spans array<struct<word: long, words: long, kind: string, label: string>>, "
    "expressions array<struct<text: string, valid: boolean, labels: array<string>, level: int>>, labels array<string>, score double"
)


def licence_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, places of base phrases, other spans, expressions, labels (distinct, sorted) and score of every whole text."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": [s.n_words for s in found],
                "base": [[{"word": w, "label": x} for w, x in s.base] for s in found],
                "spans": [[dict(zip(("word", "words", "kind", "label"), x, strict=True)) for x in s.spans] for s in found],
                "expressions": [[{"text": e.text, "valid": e.valid, "labels": sorted(e.labels), "level": e.level} for e in s.expressions] for s in found],
                "labels": [sorted(s.labels) for s in found],
                "score": [s.score for s in found],
            }
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(c).type) for c, x in columns.items()], schema=schema)

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
