"""What a page's markup says by itself, whatever its document: its statement, its tables' headers and rows, its prose lines.

Pages are read in Arrow batches; of pages that are rejected or show no statement only that is kept.
Words are looked for by parts that many of them share, and rows and lines by what the whole
table or page has, so most of them cost nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquill.functions.markup import Table, known_labels, parts_of
from finquill.operators import pages as paging
from finquill.operators.text import REJECTED_PAGES, STATEMENT_WORDS

HEADER_ROWS = 3
# Words of label columns, and cells that stand for nothing.
LABEL_WORDS = ("particular", "asset", "liabilit", "equity", "description")
EMPTY_CELLS = ("", "=", "·", "二", "。", "nil", "n.a.", "na")
#: Years that a header can name: those of ``years_in`` and the years before them.
_NAMED = {s: y for y in range(2009, 2036) for s in (str(y), str(y)[2:])}
_NUMBER = re.compile(r"\b[0-9]+\b")
_NOTE_CELL = re.compile(r"(?:Note\s*(?:No\.?)?\s*)?\d{1,3}", re.ASCII | re.IGNORECASE)
_TOKENS, _TOKEN = re.compile(r"\s+", re.ASCII), re.compile(r"\(?[-–—]?\d[\d,.]*\)?%?|[-–—]", re.ASCII)
#: Headers and footers: those that begin a text, and those within it (by their first word).
_EDGE = re.compile("|".join(p for p in paging.HEADER_FOOTER if p[0] == "^"), re.ASCII)
_WITHIN = {re.match("[a-z]+", p)[0]: re.compile(p, re.ASCII) for p in paging.HEADER_FOOTER if p[0] != "^"}
_SKIPPED = {re.match("[a-z]+", p)[0]: re.compile(p, re.ASCII) for p in paging.PROSE_SKIP}
_SECTIONS = [(re.search("[a-z]{4,}", p.replace("s?", ""))[0], re.compile(p, re.ASCII), name) for p, name in paging.SECTIONS]
_SPELLED = [re.compile(p, re.ASCII) for p in paging.YEAR_PATTERNS]
_KINDS = list(paging.PAGE_TYPES)
_MAIN = [_KINDS.index(name) for name in paging.MAIN_STATEMENTS]

#: Labels of a cell are joined by line breaks, amounts by spaces: neither has any within.
FACTS = (
    "years array<int>, rejected boolean, source_statement string, "
    "tables array<struct<note_number: string, width: int, named: array<int>, named_cols: array<int>, first_col: int, other_col: int, voted_label: int, note_col: int, "
    "letters: array<int>, jammed: array<string>, jammed_row: int, rows: array<struct<row_no: int, evidence: string, labels: array<string>, amounts: array<struct<c: int, v: string>>>>>>, "
    "lines array<struct<line_no: int, line: string, section: string>>, note_number string"
)


def _shared_parts(words: Iterable[str], size: int = 5) -> list[tuple[str, list[str]]]:
    """Parts of words with the words that have them; each word is under one part."""
    left, out = sorted(set(words)), []
    while left:
        often = Counter(p for w in left for p in ({w[i : i + size] for i in range(len(w) - size + 1)} or {w}))
        part = max(often, key=lambda p: (often[p], p))
        out.append((part, [w for w in left if part in w]))
        left = [w for w in left if part not in w]
    return out


_HINTS = [words for _, words in paging.STATEMENT_HINTS]
_PARTS = _shared_parts(w for words in [*paging.TYPE_WORDS, *_HINTS, REJECTED_PAGES, STATEMENT_WORDS] for w in words)
#: The lists of TYPE_WORDS that have a word, as often as they have it.
_LISTS = {w: [k for k, words in enumerate(paging.TYPE_WORDS) for x in words if x == w] for _, words in _PARTS for w in words}


def judged(low: str) -> tuple[bool, str]:
    """Whether a page (in lower case) is rejected, and its statement: the rules of ``is_rejected_page``, ``page_types`` and ``statement_type``."""
    seen = {w for part, words in _PARTS if part in low for w in words if w in low}
    if not seen:
        return False, "Other"
    counts = [0] * len(paging.TYPE_WORDS)
    for w in seen:
        for k in _LISTS[w]:
            counts[k] += 1
    rejected = not seen.isdisjoint(REJECTED_PAGES) and seen.isdisjoint(STATEMENT_WORDS)
    stand = [(-n, k) for k, n in enumerate(counts[: len(_KINDS)]) if n > 0 and (n > 1 or counts[len(_KINDS) + k] > 0 or not paging.TYPE_WORDS[len(_KINDS) + k])]
    if counts[2 * len(_KINDS)] or not stand:
        return rejected, "Other"
    best = min(stand)[1]
    if best in _MAIN:
        return rejected, _KINDS[best]
    if _KINDS[best] != "Notes to Accounts":
        return rejected, "Other"
    main = [x for x in stand if x[1] in _MAIN]
    if main:
        return rejected, _KINDS[min(main)[1]]
    return rejected, next((name for name, words in paging.STATEMENT_HINTS if not seen.isdisjoint(words)), "Balance Sheet")


def years_of(low: str) -> list[int]:
    """``years_in`` of a text in lower case."""
    return [y for p in _SPELLED for y in map(int, p.findall(low)) if 2010 <= y <= 2035] if "mar" in low or "year" in low else []


def _winner(votes: list[int]) -> int | None:
    """The most frequent vote, of equal ones the first."""
    return max(votes, key=votes.count) if votes else None


@lru_cache(1 << 15)
def _cell_votes(cell: str) -> tuple[set[int], int, bool, bool]:
    """The years that a header's cell names, how many years of this century it has, and whether it is one of labels or notes."""
    low = cell.lower()
    numbers = _NUMBER.findall(low)
    names = {_NAMED[n] for n in numbers if n in _NAMED}
    if "31st march" in low:
        names |= {y for y in range(2009, 2036) if str(y) in low}
    return names, sum(len(n) == 4 and n[:2] == "20" for n in numbers), any(w in low for w in LABEL_WORDS), "note" in low


def header_votes(rows: list[list[str]]) -> dict[str, object]:
    """Columns that the first rows of a table name: of each year, of years where the document's aren't known, of labels and of notes.

    Cells vote; the most votes win, of equal ones the first.  Without a vote for the labels there are the letters below the header in each column.
    """
    by_year: dict[int, list[int]] = {}
    years, label, note = [], [], []
    for row in rows[:HEADER_ROWS]:
        for j, cell in enumerate(row):
            names, n_years, is_label, is_note = _cell_votes(cell)
            for y in names:
                by_year.setdefault(y, []).append(j)
            years += [j] * n_years
            if is_label:
                label.append(j)
            if is_note:
                note.append(j)
    width = len(rows[0])
    letters = None if label else [sum(map(str.isalpha, "".join(r[j] for r in rows[HEADER_ROWS:] if j < len(r)))) for j in range(max(width, 1))]
    first = years[0] if years else None
    at = _winner(note)
    return {"width": width, "by_year": {y: _winner(v) for y, v in by_year.items()}, "first_col": first, "other_col": _winner([j for j in years if j != first]), "voted_label": _winner(label), "note_col": -1 if at is None else at, "letters": letters}


def amounts_of(cell: str) -> str:
    """Amounts and dashes of a cell, joined by spaces; none in a note's number and in a cell that stands for nothing."""
    if _TOKEN.fullmatch(cell) and cell[-1] not in ",.":
        return "" if len(cell) < 4 and cell.isdecimal() else cell
    return _amounts_within(cell)


@lru_cache(1 << 15)
def _amounts_within(cell: str) -> str:
    if _NOTE_CELL.fullmatch(cell) or cell.strip(" ") in EMPTY_CELLS:
        return ""
    return " ".join(t for t in (x.rstrip(",.;:") for x in _TOKENS.split(cell.strip(" "))) if _TOKEN.fullmatch(t))


@lru_cache(1 << 15)
def labels_of(cell: str) -> str:
    """Known labels of a cell, or the cell itself, joined by line breaks; empty without a letter."""
    return "\n".join(known_labels(cell) or [cell.strip()]) if any(map(str.isalpha, cell)) else ""


def _refused(low: str, words: list[str], within: list[re.Pattern]) -> bool:
    return bool(any(w in low for w in words) or _EDGE.match(low) or any(p.search(low) for p in within))


def _present(low: str) -> tuple[list[str], list[re.Pattern]]:
    """Words of rows that are no values, and patterns of headers and footers, that a text may have."""
    return [w for w in paging.REJECT_WORDS if w in low], [p for w, p in _WITHIN.items() if w in low]


def table_rows(table: Table) -> list[tuple[int, str, list[str], list[tuple[int, str]]]]:
    """(row, evidence, labels of each cell, amounts by column) of a table's rows but headers, footers and rows of reports about statements."""
    lines = [" | ".join(row) for row in table["rows"]]
    lows = [line.lower() for line in lines]
    whole = "\n".join(lows)
    words, within = _present(whole)
    header = [w for w in paging.HEADER_WORDS if w in whole]
    out = []
    for r, row in enumerate(table["rows"]):
        # no header word has a sign that joins cells
        if any(w in lows[r] for w in header) or _refused(lows[r].strip(" "), words, within):
            continue
        inherited = table["inherited"][r]
        out.append((r, lines[r], [labels_of(c) if c[:1].isalpha() or not _TOKEN.fullmatch(c) else "" for c in row], [(j, v) for j, c in enumerate(row) if not inherited[j] and (v := amounts_of(c))]))
    return out


def prose_lines(lines: list[tuple[int, str]]) -> list[tuple[int, str, str | None]]:
    """(line, text, section opened last) of lines that may end in an amount; lines that can't be values open no section."""
    whole = "\n".join(line for _, line in lines).lower()
    skipped = [p for w, p in _SKIPPED.items() if w in whole]
    opening = [(p, name) for w, p, name in _SECTIONS if w in whole]
    words, within = _present(whole)
    section, out = None, []
    for k, line in lines:
        low = line.lower()
        if len(low) < 8 or any(p.search(low) for p in skipped):
            continue
        name = next((name for p, name in opening if p.search(low)), None)
        if name is not None:
            section = name.format("Assets" if "asset" in low else "Liabilities")
        if (line[-1].isdecimal() or line[-1] in ".,)-") and not _refused(low.strip(" "), words, within):
            out.append((k, line, section))
    return out


def _listed(sizes: list[int], values: pa.Array, missing: list[bool] | None = None) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype="int32")
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=None if missing is None else pa.array(missing, pa.bool_()))


def _flat(lists: Iterable[list], kind: pa.DataType) -> pa.Array:
    lists = list(lists)
    return _listed([len(x or ()) for x in lists], pa.array([v for x in lists for v in x or ()], kind), [x is None for x in lists] if None in lists else None)


def _struct(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _arrays(texts: list[str | None]) -> list[pa.Array]:
    """The columns of FACTS.  Lists are put together from flat ones, without an object for each part."""
    years, rejected, statements, tables, n_tables, lines, n_lines, last_notes = [], [], [], [], [], [], [], []
    for text in texts:
        low = (text or "").lower()
        found = judged(low)
        years.append(years_of(low))
        rejected.append(found[0])
        statements.append(found[1])
        if found[0] or found[1] == "Other":
            n_tables.append(0)
            n_lines.append(0)
            last_notes.append("")
            continue
        parts = parts_of(text)
        for t in parts["tables"]:
            before = [n["note"] for n in parts["notes"] if n["at"] <= t["at"]]
            tables.append({**header_votes(t["rows"]), "note": before[-1] if before else "", "jammed": t["jammed"], "jammed_row": t["jammed_row"], "rows": table_rows(t)})
        prose = prose_lines(parts["lines"])
        lines += prose
        n_tables.append(len(parts["tables"]))
        n_lines.append(len(prose))
        last_notes.append(parts["notes"][-1]["note"] if parts["notes"] else "")
    rows = [r for t in tables for r in t["rows"]]
    amounts = [a for r in rows for a in r[3]]
    text, whole = pa.string(), pa.int32()
    each_amount = _struct(c=pa.array([c for c, _ in amounts], whole), v=pa.array([v for _, v in amounts], text))
    each_row = _struct(row_no=pa.array([r[0] for r in rows], whole), evidence=pa.array([r[1] for r in rows], text), labels=_flat((r[2] for r in rows), text), amounts=_listed([len(r[3]) for r in rows], each_amount))
    single = {c: pa.array([t[c] for t in tables], whole) for c in ("width", "first_col", "other_col", "voted_label", "note_col", "jammed_row")}
    each_table = _struct(
        note_number=pa.array([t["note"] for t in tables], text), width=single["width"], named=_flat((list(t["by_year"]) for t in tables), whole), named_cols=_flat((list(t["by_year"].values()) for t in tables), whole),
        first_col=single["first_col"], other_col=single["other_col"], voted_label=single["voted_label"], note_col=single["note_col"], letters=_flat((t["letters"] for t in tables), whole),
        jammed=_flat((t["jammed"] for t in tables), text), jammed_row=single["jammed_row"], rows=_listed([len(t["rows"]) for t in tables], each_row),
    )
    each_line = _struct(line_no=pa.array([k for k, _, _ in lines], whole), line=pa.array([x for _, x, _ in lines], text), section=pa.array([s for _, _, s in lines], text))
    return [_flat(years, whole), pa.array(rejected, pa.bool_()), pa.array(statements, text), _listed(n_tables, each_table), _listed(n_lines, each_line), pa.array(last_notes, text)]


def with_facts(pages: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``pages`` but the text, with FACTS of each page."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keys = [c for c in pages.columns if c != text]
    rows = pages.select(*keys, F.col(text).alias("__text"))
    schema = StructType([*(rows.schema[c] for c in keys), *StructType.fromDDL(FACTS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                made = [some.column(c).cast(arrow.field(c).type) for c in keys] + _arrays(some.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(made, names=arrow.names)

    return rows.mapInArrow(run, schema)
