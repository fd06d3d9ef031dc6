"""What built-in expressions can't do with the markup of a page: grids of HTML and Markdown tables, lines outside them.

A page is taken at a time and nothing is kept between pages.  Spans above SPAN are cut to it; a
table with a span that is no number is left out, as it has no grid.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import TypedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.functions.procedural import LABELS, notes_of

SPAN = 1000
#: A cell with more known labels than this, near the top of a table, holds the labels of the rows below it.
JAMMED = 5
_CANON = {x.lower(): x for x in reversed(LABELS)}
_SHORTEST = min(map(len, _CANON))
_KNOWN = re.compile("(?=(" + "|".join(re.escape(x) for x in sorted(_CANON, key=len, reverse=True)) + "))")
_TABLE = re.compile(r"<table[^>]*>[^<]*(?:<(?!/table>)[^<]*)*</table>", re.IGNORECASE)
_TAG = re.compile(r"<[^>]+>")
#: A table of bare rows and cells, without spans, entities or other tags: its grid needs no parser.
_BARE = re.compile(r"<table>(?:<tr>(?:<t[dh]>[^<&]*</t[dh]>)*</tr>)*</table>")
_BARE_CELL = re.compile(r"<t[dh]>([^<]*)</t[dh]>")
_RULE = re.compile(r"[ |:-]*")


def known_labels(text: str | None) -> list[str]:
    """Known labels in a cell from left to right, in their usual spelling; of two that overlap the longer stays, of equal ones the first."""
    kept: list[tuple[int, int, str]] = []
    for m in _KNOWN.finditer((text or "").lower()):
        start, end = m.start(), m.end(1)
        if kept and start < kept[-1][1]:
            if end - start <= kept[-1][1] - kept[-1][0]:
                continue
            kept.pop()
        kept.append((start, end, _CANON[m[1]]))
    return [x for _, _, x in kept]


class _Grid(HTMLParser):
    """Rows of (text, rows, columns) of one table."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[tuple[str, int, int]]] = []
        self.row: list[tuple[str, int, int]] = []
        self.cell: list[str] | None = None
        self.span: dict[str, str | None] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell, self.span = [], dict(attrs)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            down, right = (min(int(self.span.get(k) or 1), SPAN) for k in ("rowspan", "colspan"))
            self.row.append(("".join(self.cell).strip().replace("\n", " "), down, right))
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append(self.row)


def grid(html: str) -> tuple[list[list[str]], list[list[bool]]]:
    """Texts of a table's cells, spans filled in, and whether a cell comes from a row above."""
    if _BARE.fullmatch(html):
        rows = [[c.strip().replace("\n", " ") for c in _BARE_CELL.findall(row)] for row in html.split("<tr>")[1:]]
        rows = [row for row in rows if row]
        return rows, [[False] * len(row) for row in rows]
    parser = _Grid()
    parser.feed(html)
    cells: list[dict[int, tuple[str, bool]]] = [{} for _ in parser.rows]
    for r, row in enumerate(parser.rows):
        c = 0
        for text, down, right in row:
            while c in cells[r]:
                c += 1
            for i in range(r, r + down):
                if i == len(cells):
                    cells.append({})
                for j in range(c, c + right):
                    cells[i][j] = (text, i > r)
            c += right
    full = [[row.get(c, ("", False)) for c in range(max(row, default=-1) + 1)] for row in cells]
    return [[t for t, _ in row] for row in full], [[i for _, i in row] for row in full]


def _html_of(lines: list[str]) -> str:
    rows = []
    for k, line in enumerate(lines):
        if k == 1 and _RULE.fullmatch(line.strip()):
            continue
        tag = "th" if k == 0 else "td"
        rows.append("<tr>" + "".join(f"<{tag}>{c.strip()}</{tag}>" for c in line.split("|")[1:-1]) + "</tr>")
    return f"<table>{''.join(rows)}</table>"


def markdown_to_html(text: str) -> str:
    """Blocks of lines between pipes as one line of HTML each."""
    out: list[str] = []
    held: list[str] = []
    for line in [*text.split("\n"), None]:
        bare = line.strip() if line is not None else ""
        if bare.startswith("|") and bare.endswith("|"):
            held.append(bare)
            continue
        if held:
            out.append(_html_of(held))
            held = []
        if line is not None:
            out.append(line)
    return "\n".join(out)


class Table(TypedDict):
    """A table of a page: where it begins, its cells, and the labels of a cell that holds those of the rows below it."""

    at: int
    rows: list[list[str]]
    inherited: list[list[bool]]
    jammed: list[str]
    jammed_row: int


def _jammed(rows: list[list[str]]) -> tuple[list[str], int]:
    for r, row in enumerate(rows[:3]):
        for cell in row[:3]:
            # known labels that don't overlap need room (a letter has at most two in lower case)
            if 2 * len(cell) > JAMMED * _SHORTEST and len(cell.lower()) > JAMMED * _SHORTEST and len(found := known_labels(cell)) > JAMMED:
                return found, r
    return [], -1


def parts_of(text: str | None) -> dict[str, list]:
    """The tables of a page, the lines outside them (number, text), and the notes."""
    text = text or ""
    text = markdown_to_html(text) if "|" in text else text
    tables: list[Table] = []
    for m in _TABLE.finditer(text):
        try:
            rows, inherited = grid(m[0])
        except ValueError:
            continue
        if rows:
            labels, at = _jammed(rows)
            tables.append({"at": m.start(), "rows": rows, "inherited": inherited, "jammed": labels, "jammed_row": at})
    lines, inside = [], False
    for k, line in enumerate(text.split("\n")):
        inside = inside or "<table" in line
        if "</table>" in line:
            inside = False
        elif not inside:
            lines.append((k, (_TAG.sub("", line) if "<" in line else line).strip()))
    low = text.lower()
    return {"tables": tables, "lines": lines, "notes": notes_of(text) if "note" in low or "chedule" in low else []}


def page_markup(pages: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``pages`` but the text, with its markup: Markdown tables as HTML."""
    # without a pipe there is no Markdown table, and such texts stay where they are
    html = F.pandas_udf(lambda s: s.map(lambda t: markdown_to_html(t) if t else t), "string")(F.when(F.contains(F.col(text), F.lit("|")), F.col(text)))
    return pages.select(*[c for c in pages.columns if c != text], F.coalesce(html, F.col(text), F.lit("")).alias("markup"))
