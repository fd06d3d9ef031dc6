"""Compression of vectors to short codes: one codebook per part, entries found by VA-file filtering.

A component x becomes the integer floor(256 x); a vector is cut into PARTS consecutive parts and
each part is named by the nearest entry of its codebook (squared Euclidean distance, ties to the
lower index).  The search for it is that of a VA-file: every coordinate of the entries is
quantised to a cell of BITS bits; a query's lookup tables hold, by coordinate and cell, the least
and the greatest squared distance to what lies in the cell; their sums over an entry's cells
bound its distance from below and above.  Only entries whose lower bound doesn't exceed the least
upper bound are refined, with integer distances.  All numbers are integers, so results are exact.

Codebooks start as the parts of the ENTRIES smallest ids.  Each round is one pass over the
vectors: tasks return sums and counts by part and entry, which are added up by a shuffle of at
most parts x entries rows a task; the codebooks (that many rows) go through the driver.

Edge cases.  Vectors that are null, empty or hold null or non-finite components are dropped; so
are those of another length than the vector of the smallest id.  Null ids come last; rows of one
id are ordered by their vectors, and all of them count.  A length that PARTS doesn't divide gives
parts that differ by one component (or have none, code 0).  Fewer vectors than ENTRIES give
fewer entries; no vectors give no rows.  Components are held within a bound (``_limit``) beyond
which distances of whole vectors wouldn't fit a long; a sum over a label that doesn't is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 4
#: Vectors that a task looks at in one go.
BLOCK = 4096
#: Rows of one label go to so many tasks.
SALTS = 32


def _limit(dims: int) -> int:
    return int((2**60 / max(dims, 1)) ** 0.5)


def kept(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label") -> DataFrame:
    """vec_id, label and the vector in doubles, of the rows that take part (of any length)."""
    x = F.col(f"`{vector_column}`").cast("array<double>")
    v = F.col("vector")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.col(f"`{label_column}`") if label_column else F.lit(None).cast("int")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), label.alias("label"), x.alias("vector"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~odd)


def whole(flat: np.ndarray, dims: int) -> np.ndarray:
    """Vectors in integers, one a row."""
    limit = _limit(dims)
    return np.clip(np.floor(flat.reshape(-1, dims) * 256.0), -limit, limit).astype(np.int64)


def bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    edges = [dims * p // parts for p in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


class Cells:
    """Entries of one part with their coordinates in cells, and the least and greatest coordinate of each cell."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, self.n = entries, 1 << bits
        low, high = entries.min(0), entries.max(0)
        self.cell = ((entries - low) * self.n) // np.maximum(high - low + 1, 1)
        dims = entries.shape[1]
        self.low, self.high = np.zeros((dims, self.n), np.int64), np.zeros((dims, self.n), np.int64)
        for d in range(dims):
            for c in np.unique(self.cell[:, d]):
                here = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = here.min(), here.max()

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each query's nearest entry and the squared distance."""
        n, dims = queries.shape
        if not dims:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        lower = np.zeros((n, len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(dims):
            below, above = self.low[d] - queries[:, d, None], queries[:, d, None] - self.high[d]
            least = np.maximum(np.maximum(below, above), 0) ** 2  # lookup tables: a row per query, a column per cell
            most = np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += least[:, self.cell[:, d]]
            upper += most[:, self.cell[:, d]]
        query, entry = np.nonzero(lower <= upper.min(1, keepdims=True))  # in order of queries, then entries
        exact = ((queries[query] - self.entries[entry]) ** 2).sum(1)
        first = np.searchsorted(query, np.arange(n))
        distance = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == distance[query])
        return entry[hit[np.searchsorted(query[hit], np.arange(n))]], distance


class Codebooks:
    """The entries of every part."""

    def __init__(self, parts: list[np.ndarray], dims: int):
        self.parts, self.dims = parts, dims

    @classmethod
    def first(cls, rows: np.ndarray, parts: int) -> Codebooks:
        return cls([rows[:, a:b].copy() for a, b in bounds(rows.shape[1], parts)], rows.shape[1])

    def cells(self) -> list[Cells]:
        return [Cells(x) for x in self.parts]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(c) for x in self.parts for c in x.ravel().tolist()).encode()).hexdigest()

    def replaced(self, rows: Iterator[tuple[int, int, list[int], int]]) -> Codebooks:
        """Used entries become the floor of their parts' means."""
        parts = [x.copy() for x in self.parts]
        for part, entry, sums, n in rows:
            parts[part][entry] = [int(s) // n for s in sums]
        return Codebooks(parts, self.dims)


def _vectors(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield part, whole(part.column("vector").flatten().to_numpy(zero_copy_only=False), dims)


def _assigned(cells: list[Cells], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for c, (a, b) in zip(cells, bounds(x.shape[1], len(cells)), strict=True):
        yield x[:, a:b], *c.nearest(x[:, a:b])


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Sums and counts of a task's parts by part and entry."""
    cells = books.cells()
    sums, counts = [np.zeros(x.shape, np.int64) for x in books.parts], [np.zeros(len(x), np.int64) for x in books.parts]
    for batch in batches:
        for _, x in _vectors(batch, books.dims):
            for p, (own, entry, _) in enumerate(_assigned(cells, x)):
                np.add.at(sums[p], entry, own)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
    found = [(p, e, d, int(v), int(n[e])) for p, n in enumerate(counts) for e in np.flatnonzero(n).tolist() for d, v in enumerate(sums[p][e])]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["part", "entry", "place", "total", "n"])


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``kept`` vectors; None without any."""
    start = vectors.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not start:
        return None
    dims = len(start[0]["vector"])
    own = vectors.where(F.size("vector") == dims)
    if any(len(r["vector"]) != dims for r in start):
        start = own.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    books = Codebooks.first(whole(np.array([r["vector"] for r in start], np.float64), dims), parts)
    for _ in range(rounds):
        summed = own.select("vector").mapInArrow(partial(_sums, books=books), "part long, entry long, place long, total long, n long")
        found = summed.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # a row per component of the codebooks
        totals: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        for r in found:
            totals.setdefault((r["part"], r["entry"]), {})[r["place"]] = (int(r["total"]), r["n"])
        books = books.replaced((p, e, [x[d][0] for d in sorted(x)], x[0][1]) for (p, e), x in totals.items())
    return books


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, ``codes`` (array of int, one per part) and ``error`` (squared distances summed over the parts)."""
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, codes array<int>, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = books.cells()
        for batch in batches:
            for rows, x in _vectors(batch, books.dims):
                found = [(entry, distance) for _, entry, distance in _assigned(cells, x)]
                codes = pa.array(np.stack([e for e, _ in found], 1).astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(cells), pa.int32()), codes)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), lists, pa.array(sum(d for _, d in found))], ["vec_id", "label", "codes", "error"])

    return vectors.where(F.size("vector") == books.dims).select("vec_id", "label", "vector").mapInArrow(run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the error summed over equal labels, nulls together.

    The sums are joined back by label and a salt, so that rows of one label meet their sum in
    SALTS tasks; the sums are repeated that often.
    """
    salt = F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_own", salt)
    return rows.join(sums, rows["label"].eqNullSafe(sums["_label"]) & (rows["_own"] == sums["_salt"])).drop("_own", "_label", "_salt")


def hex_code(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def decode(codes: list[int], books: Codebooks) -> np.ndarray:
    """The vector that a code stands for, on the scale of the original."""
    return np.concatenate([x[c] for x, c in zip(books.parts, codes, strict=True)]) / 256.0
