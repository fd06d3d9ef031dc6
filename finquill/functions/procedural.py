"""The few functions that built-in expressions can't give, as Arrow-batched Python."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels that tables often join in one cell.
LABELS = (
    "Share Capital", "Reserves and Surplus", "Reserves & Surplus", "Long-Term Borrowings", "Long Term Borrowings",
    "Other Long term Liabilities", "Other Long-Term Liabilities", "Long Term Provisions", "Long-Term Provisions",
    "Short-Term Borrowings", "Short Term Borrowings", "Trade Payables", "Other Current Liabilities",
    "Short-Term Provisions", "Short Term Provisions", "Property Plant and Equipment", "Property, Plant and Equipment",
    "Intangible Assets", "Capital work-in-progress", "Capital work in progress", "Intangible Assets under development",
    "Non-Current Investments", "Deferred Tax Asset", "Deferred Tax Assets", "Long-Term Loans and Advances",
    "Long -Term Loans and Advances", "Other Non Current Assets", "Other Non-Current Assets", "Trade Receivables",
    "Cash and Cash Equivalents", "Bank balance other than cash and cash equivalent", "Bank balances other than cash",
    "Short-Term Loans and Advances", "Short - Term Loans and Advances", "Other Current Assets",
    "Revenue from Operations", "Other Income", "Total Income", "Cost of Materials Consumed",
    "Purchases of Stock-in-Trade", "Changes in inventories", "Employee Benefits Expense", "Finance Costs",
    "Depreciation and Amortization", "Depreciation and Amortisation", "Other Expense", "Other Expenses",
    "Total Expense", "Profit before tax", "Profit after tax", "Profit for the year", "Earnings per equity share", "TOTAL",
)
# How texts refer to a note, in order.
NOTE_PATTERNS = (
    r"Note\s*(\d{1,3})\s*[-–—:.]",
    r"Note\s*(?:No\.?\s*)?(\d{1,3})",
    r"Schedule\s+([IVX]+|\d{1,3})",
    r"note\s+(\d{1,3})\s*(?:[-–]|$)",
)


def repaired(raw: str | None) -> str | None:
    """Valid JSON for a broken object, or null: cut to the outer braces, clean numbers, close what is open."""
    if raw is None:
        return None
    for text in (raw, raw[raw.find("{") :] if "{" in raw else raw):
        for candidate in (text, _cleaned(text), _closed(_cleaned(text)), _closed(_cleaned(_escaped(text)))):
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False)
            except ValueError:
                continue
    return None


def _cleaned(text: str) -> str:
    """Numbers after a colon without thousands separators; half-quoted numbers and nulls unquoted."""
    text = re.sub(r'(:\s*)"?(-?\d{1,3}(?:,\d{2,3})+(?:\.\d+)?)"?(?=\s*[,}\]\n]|$)', lambda m: m[1] + m[2].replace(",", ""), text)
    return re.sub(r'(:\s*)(?:"(-?\d+(?:\.\d+)?|null)(?=\s*[,}\n])|(-?\d+(?:\.\d+)?|null)"(?=\s*[,}\n]))', lambda m: m[1] + (m[2] or m[3]), text)


def _escaped(text: str) -> str:
    """Quotes within a string escaped: a quote ends a string only where a sign of structure or the end follows."""
    out, inside = [], False
    for i, c in enumerate(text):
        if c == '"' and (i == 0 or text[i - 1] != "\\"):
            if not inside:
                inside = True
            elif (rest := text[i + 1 :].lstrip()[:1]) == "" or rest in ",:}]":
                inside = False
            else:
                out.append("\\")
        out.append(c)
    return "".join(out)


def _closed(text: str) -> str:
    open_brackets, in_string, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\" and in_string:
            escaped = True
        elif c == '"':
            in_string = not in_string
        elif not in_string and c in "{[":
            open_brackets.append("}" if c == "{" else "]")
        elif not in_string and c in "}]" and open_brackets:
            open_brackets.pop()
    text = re.sub(r"[,\s]+$", "", text + ('"' if in_string else ""))
    return text + "".join(reversed(open_brackets))


def _repair(raw: pd.Series) -> pd.Series:
    return raw.map(repaired)


def repair_json(raw):
    """Column of valid JSON, or null."""
    return F.pandas_udf(_repair, "string")(raw)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set_ratio(a, b):
    """Similarity of the word sets of two columns, 0 to 100."""
    return F.pandas_udf(_ratios, "double")(a, b)


def _token_set(a: str | None, b: str | None) -> float:
    x, y = set(re.findall(r"\w+", (a or "").lower())), set(re.findall(r"\w+", (b or "").lower()))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    return round(100 * max(SequenceMatcher(None, p, q).ratio() for p, q in ((both, left), (both, right), (left, right)) if p and q), 2)


_NOTES = tuple(re.compile(p, re.IGNORECASE) for p in NOTE_PATTERNS)
_TAG = re.compile(r"<[^>]+>")


def notes_of(text: str | None) -> list[dict[str, object]]:
    """Notes with position and surroundings, by position; a place that fits several spellings counts for each."""
    plain = _TAG.sub(" ", text or "")
    loosest = _NOTES[1].search(plain)
    # where the loosest spelling of a note isn't, the stricter ones aren't either
    spelled = [(k, p) for k, p in enumerate(_NOTES) if k == 2 or loosest]
    found = [(m.start(), k, m[1], plain[max(0, m.start() - 30) : m.end() + 30].strip()) for k, p in spelled for m in p.finditer(plain)]
    return [{"note": n, "at": at, "context": around} for at, _, n, around in sorted(found)]


def note_refs(text):
    """Column of (note, at, context): references to notes with their positions."""
    return F.pandas_udf(lambda s: s.map(notes_of), "array<struct<note:string,at:int,context:string>>")(text)


def _labels(cell: pd.Series) -> pd.Series:

    def of(text: str | None) -> list[str]:
        low = (text or "").lower()
        spans = sorted(((m.start(), m.end()) for x in LABELS for m in re.finditer(re.escape(x.lower()), low)), key=lambda s: (s[0] - s[1], s[0]))
        kept: list[tuple[int, int]] = []
        for s, e in spans:
            if all(e <= a or s >= b for a, b in kept):
                kept.append((s, e))
        return [text[s:e] for s, e in sorted(kept)]

    return cell.map(of)


def split_labels(cell):
    """Known labels in a cell from left to right; where two overlap the longer one stays."""
    return F.pandas_udf(_labels, "array<string>")(cell)


class _Grid(HTMLParser):
    """Cells of all tables with row and column spans filled in."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
            self.span = tuple(int(v) if (v := at.get(k) or "1").isdigit() and 0 < int(v) < 1000 else 1 for k in ("rowspan", "colspan"))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None

    def cells(self) -> Iterator[tuple[int, int, int, str, bool]]:
        """(table, row, column, text, inherited)."""
        for t, rows in enumerate(self.tables):
            held: dict[tuple[int, int], str] = {}
            for r, row in enumerate(rows):
                column = 0
                for value, down, right in row:
                    while (r, column) in held:
                        column += 1
                    for i in range(r, min(r + down, len(rows))):
                        for j in range(column, column + right):
                            held[i, j] = value
                            yield t, i, j, value, (i, j) != (r, column)
                    column += right


def html_cells(pages: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, col_no, text, inherited) of all tables of ``html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grid = _Grid()
                grid.feed(html or "")
                out += [(k, *c) for c in grid.cells()]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "table_no", "row_no", "col_no", "text", "inherited"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInArrow(run, f"{key} {kind}, table_no int, row_no int, col_no int, text string, inherited boolean")
