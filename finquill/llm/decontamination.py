"""Benchmark decontamination with a generalised suffix automaton of the items.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters above
ASCII.  A window is ``window`` consecutive words of an item; an item of fewer
words (but not none) is one window.  The automaton of all items streams over a
document's words and keeps the longest match that ends at each of them, which
says where windows end.  Streaming starts only in stretches whose neighbouring
words are neighbours in some item (a hash table of word pairs): elsewhere no
window can lie, so this drops nothing.

Items are dealt to automata of at most AUTOMATON_WORDS words each, longer items in
pieces that overlap by a window; a pass over the documents is made for each automaton
and the spans are joined.  So what is sent to executors at once has a fixed bound
however large the benchmark is.

Edge cases: null or empty texts and items have no words; an item without words is
never found; repeated items are found together; a null item_id is ignored; very
long texts are streamed slice by slice; null doc_ids are kept; empty tables give
empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import cut, remove, slices, utf8, worker_slot

WINDOW = 10
#: An automaton of so many words takes some 100 MB in a worker.
AUTOMATON_WORDS = 200_000
#: Spans of at least so many words are removed from a document.
SPAN_LIMIT = 10
#: A document of which more than this share is hit is removed as a whole.
COVERAGE_LIMIT = 0.5

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: A-Z to a-z; other ASCII but digits and a-z to a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SEPARATORS else c for c in range(256))
_TABLE_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        sequences = []
        for name, words in items:
            if words:
                sequences.append((name, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[str]] = [set()]
        mark, last = -1, 0  # a separator of its own after every item, so no match crosses items
        for name, ids in sequences:
            for k, c in enumerate([*ids, mark]):
                last = self._extend(last, c, ends)
                if k < len(ids):
                    ends[last].add(name)
            mark -= 1
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        #: the ancestor (or itself) that holds the window ending here, and the items of its windows
        self.items: list[set[str] | None] = [None] * len(self.len)
        for s in order:
            parent = self.link[s]
            if self.len[s] >= window:
                if self.len[parent] >= window:
                    ends[parent] |= ends[s]
                else:
                    self.items[s] = ends[s]
        self.window_state = [-1] * len(self.len)
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.len)
        own: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        for name, ids in sequences:
            if len(ids) < window:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                own.setdefault(state, []).append((len(ids), name))
                self.least = min(self.least, len(ids))
        for s in reversed(order):
            parent = self.link[s]
            if self.len[s] >= window:
                self.window_state[s] = s if self.len[parent] < window else self.window_state[parent]
            self.short[s] = self.short[parent] + tuple(own.get(s, ()))
        self.pairs = np.zeros(1 << _TABLE_BITS, bool)
        for _, ids in sequences:
            a = np.array(ids, np.int64)
            self.pairs[self._cell(a[:-1], a[1:])] = True

    def _extend(self, last: int, c: int, ends: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(set())
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B)) >> 7 & ((1 << _TABLE_BITS) - 1)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words in which windows can lie."""
        known = ids > 0
        if self.least > 1:
            known = known[:-1] & known[1:] & self.pairs[self._cell(ids[:-1], ids[1:])]
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].view(np.int8)))
        starts, ends = edge[::2], edge[1::2] + (self.least > 1)
        fit = ends - starts >= self.least
        return list(zip(starts[fit].tolist(), ends[fit].tolist(), strict=True))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (word numbers, end exclusive, joined where they meet), items found, longest match."""
        if len(words) < self.least or not self.vocab:
            return [], set(), 0
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        nxt, link, length = self.next, self.link, self.len
        for start, end in self.stretches(ids):
            state = size = 0
            for at, c in enumerate(ids[start:end].tolist(), start + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c not in nxt[state]:
                    continue
                state = nxt[state][c]
                size += 1
                hit = 0
                if size >= self.window:
                    hit = self.window
                    found |= self.items[self.window_state[state]]
                for n, name in self.short[state]:
                    if n <= size:
                        hit = max(hit, n)
                        found.add(name)
                if hit:
                    longest = max(longest, size)
                    begin = at - hit
                    while spans and begin <= spans[-1][1]:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at))
        return spans, found, longest


def _automaton(shared, window: int) -> Automaton:
    """Built once in each worker from the broadcast items."""
    return worker_slot(("automaton", shared.value["key"], window), lambda: Automaton([(n, words_of(t)) for n, t in shared.value["items"]], window))


def _pieces(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    """An item in pieces of at most AUTOMATON_WORDS words that overlap, so that every window is in one."""
    size = max(AUTOMATON_WORDS, 2 * window)
    for start in range(0, max(1, len(words) - window + 1), size - window + 1) if len(words) > size else (0,):
        yield words[start : start + size]


def item_groups(items: DataFrame, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """Items with words, in groups of bounded size; the driver holds one group at a time."""
    group: list[tuple[str, bytes]] = []
    total = 0
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    for row in rows.where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        for words in _pieces(words_of(bytes(row.t)), window):
            n = len(words)
            if n and total + n > AUTOMATON_WORDS and group:
                yield group
                group, total = [], 0
            if n:
                group.append((row.i, b" ".join(words)))
                total += n
    if group:
        yield group


_FOUND = "struct<spans:array<struct<start:int,end:int>>,item_ids:array<string>,n_words:bigint,longest:int>"


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, column: str = "contamination") -> DataFrame:
    """All columns of ``docs`` (needs ``text``) with one more, ``column`` (which replaces one of
    that name): a struct of hit spans in words, ids of items found (sorted), words and
    the longest match (within a piece of an item of more than AUTOMATON_WORDS words)."""
    docs = docs.withColumn(column, F.lit(None).cast(_FOUND))
    context = docs.sparkSession.sparkContext
    before, groups = None, 0
    for group in item_groups(items, window):
        if groups:  # each pass ends before the next automaton is sent
            last, docs = before, cut(docs, "contamination")
            remove(docs.sparkSession, last)
            before = docs
        digest = hashlib.sha256(b"".join(len(x).to_bytes(8) + x for n, t in group for x in (n.encode(), t))).hexdigest()
        docs = _pass(docs, context.broadcast({"key": digest, "items": group}), window, column)
        groups += 1
    return docs if groups else _pass(docs, context.broadcast({"key": "", "items": []}), window, column)


def _join(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pass(docs: DataFrame, shared, window: int, column: str) -> DataFrame:
    kind = docs.schema[column].dataType
    arrow = pa.struct(
        [
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ("item_ids", pa.list_(pa.string())),
            ("n_words", pa.int64()),
            ("longest", pa.int32()),
        ]
    )
    assert kind.fieldNames() == [f.name for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window)
        for batch in slices(batches):
            at = batch.schema.get_field_index(column)
            out = []
            for text, old in zip(utf8(batch.column("text")), batch.column(at).to_pylist(), strict=True):
                words = words_of(text)
                spans, found, longest = automaton.find(words)
                if old:
                    spans = _join(spans, [(x["start"], x["end"]) for x in old["spans"]])
                    found |= set(old["item_ids"])
                    longest = max(longest, old["longest"])
                out.append({"spans": [{"start": s, "end": e} for s, e in spans], "item_ids": sorted(found), "n_words": len(words), "longest": longest})
            yield batch.set_column(at, batch.schema.names[at], pa.array(out, arrow))

    return docs.mapInArrow(run, docs.schema)


_ONE_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them."""
    where = [m.span() for m in _ONE_WORD.finditer(text)]
    keep, at = [], 0
    for s, e in spans:
        keep.append(text[at : where[s][0]])
        at = where[e - 1][1]
    keep.append(text[at:])
    return b"".join(keep)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, span_limit: int = SPAN_LIMIT, coverage_limit: float = COVERAGE_LIMIT) -> DataFrame:
    """The documents without benchmark passages, in their own columns.

    Documents of which more than ``coverage_limit`` of the words is hit go; of the
    rest, spans of at least ``span_limit`` words, and spans of items of fewer than ``window``
    words, are cut from the text; other spans stay.  n_chars, if there, is counted anew for them.
    """
    columns = docs.columns
    name = "contamination"
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    found = find_contamination(docs, items, window, name)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts, keep = batch.column(at).to_pylist(), []
            lengths = batch.column(columns.index("n_chars")).to_pylist() if "n_chars" in columns else None
            for i, x in enumerate(batch.column(len(columns)).to_pylist()):
                spans = [(y["start"], y["end"]) for y in x["spans"]]
                if sum(e - s for s, e in spans) > coverage_limit * x["n_words"]:
                    continue
                keep.append(i)
                if cuts := [(s, e) for s, e in spans if e - s >= span_limit or e - s < window]:
                    texts[i] = remove_spans(texts[i].encode("utf-8"), cuts).decode("utf-8")
                    if lengths:
                        lengths[i] = len(texts[i])
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            if lengths:
                arrays[columns.index("n_chars")] = pa.array(lengths, batch.schema.field(columns.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int32())) for a in arrays], columns)

    return found.mapInArrow(run, schema)
