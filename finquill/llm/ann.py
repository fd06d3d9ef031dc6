"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Index.  Rows with equal vectors are one node that keeps its LISTED smallest ids (more
can't be in any answer of ``k`` < LISTED); so a vector that a third of the rows
share costs no more than another.  A first graph joins neighbours in several orders of
random projections.  NN-descent then improves it: for each node, its neighbours and
reverse neighbours (new ones sampled, as in the published algorithm) are joined with
one another and better edges are merged in, round by round, until few change.
Rounds carry vectors as one byte per component and a scale of each vector, so that one
large vector doesn't blur the others; the graph only guides the search.

Search.  Each query starts at the nearest of ENTRIES random nodes (a bounded, measured
table) and keeps its BEAM best nodes; each hop joins the ones not yet expanded with
the graph, until nothing changes.  The best are then measured exactly, in double
precision on original vectors, and expanded to their ids.

Every loop step is written to the shared checkpoint folder (see ``cut``): lineage stays
short and lost executors cost a stage at most.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do those of another length than the most frequent one (ties: the
longer); repeated ids with equal vectors count once; ties in distance go to the smaller
id; a table with fewer candidates than ``k`` gives all of them; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquill.llm.common import BROADCAST_BYTES, cut, remove

LISTED = 11
DEGREE = 24
#: New neighbours, and reverse neighbours of either kind, that a node joins in a round.
SAMPLE = 20
ORDERS = 8
BLOCK = 1536
ROUNDS = 4
#: Rounds end when fewer than this share of the edges is new.
STILL = 0.04
#: Reverse neighbours that a node has in searches, nearest first.
BACK = 40
ENTRIES = 1024
STARTS = 32
BEAM = 256
#: Nodes of a query that a hop expands at most.
EXPANDED = 64
HOPS = 24


def _lists(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ends of lists and their flat values."""
    lengths = np.diff(np.asarray(array.offsets))
    return np.r_[0, np.cumsum(lengths)], array.flatten()


def _coded(x: np.ndarray) -> list[bytes]:
    """Rows as a scale (4 bytes) and one byte per component."""
    step = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300) / 127
    q = np.clip(np.rint(x / step[:, None]), -127, 127).astype(np.int8)
    with np.errstate(over="ignore"):
        scale = np.minimum(step, np.finfo(np.float32).max / 1e6).astype("<f4")
    return [s.tobytes() + v.tobytes() for s, v in zip(scale, q, strict=True)]


def _bytes_matrix(array: pa.Array | list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(array if isinstance(array, list) else array.to_pylist()), np.uint8).reshape(-1, dim + 4)
    return raw[:, 4:].view(np.int8) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector as array of double) of the rows that take part, and the length."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector")).where("vec_id is not null")
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = sizes[0]["n"] if sizes else 0
    return rows.where(F.size("vector") == dim), dim


def nodes_of(rows: DataFrame) -> DataFrame:
    """node (smallest id), vector and ids (LISTED smallest) of each distinct vector."""
    # only the smallest ids of a vector leave the tasks that read them (a limit before the shuffle)
    few = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= LISTED)
    return few.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("node", "vector", "ids")


def _quantised(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flat = _lists(batch.column("vector"))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(_coded(np.asarray(flat).reshape(batch.num_rows, -1)), pa.binary())], ["node", "code"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, code binary")


EDGES = "u long, v long, d float, fresh boolean"


def _edge_batch(u, v, d, fresh) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float32()), pa.array(fresh, pa.bool_())], ["u", "v", "d", "fresh"])


def _first_graph(codes: DataFrame, dim: int) -> DataFrame:
    """Edges among neighbours in several orders by random projections.

    The signs of projections are the leading key, a further projection breaks ties, so
    blocks of the order are parts of the leaves of a random projection tree.  The
    orders are dealt by range, so a dense leaf spreads over tasks.
    """
    bits = 10
    parts = []
    for k in range(ORDERS):
        planes = np.random.default_rng(100 + k).normal(size=(dim, bits + 1)).astype(np.float32)

        def place(batches: Iterator[pa.RecordBatch], planes=planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _bytes_matrix(batch.column("code"), dim)
                y = x @ planes / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-30)[:, None] * 1e4
                key = (y[:, :bits] > 0) @ (1 << np.arange(bits)[::-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key * 1e6 + np.clip(y[:, bits], -4e5, 4e5), pa.float64())], ["node", "code", "place"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = np.asarray(batch.column("node")), _bytes_matrix(batch.column("code"), dim)
                for start in range(0, len(ids), BLOCK):
                    yield from _block(ids[start : start + BLOCK], x[start : start + BLOCK])

        placed = codes.mapInArrow(place, "node long, code binary, place double")
        parts.append(placed.repartitionByRange("place", "node").sortWithinPartitions("place", "node").mapInArrow(join, EDGES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(ids)
    if n < 2:
        return
    sq = (x * x).sum(axis=1)
    d = sq[:, None] + sq[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(DEGREE // 2, n - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    yield _edge_batch(np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel(), np.ones(n * k, bool))


def _best(edges: DataFrame) -> DataFrame:
    """The DEGREE nearest distinct neighbours of each node; an edge known before isn't fresh."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    r = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return once.withColumn("r", r).where(F.col("r") <= DEGREE).select("u", "v", "d", "fresh")


def _local_join(edges: DataFrame, codes: DataFrame, dim: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Better edges found among the neighbours of each node, and the edges that were joined."""
    chance = F.xxhash64("u", "v", F.lit(seed))
    fresh = F.row_number().over(Window.partitionBy("u", "fresh").orderBy(chance))
    ahead = edges.withColumn("r", fresh).where(~F.col("fresh") | (F.col("r") <= SAMPLE))
    taken = ahead.select("u", "v", "d", "fresh")
    back = taken.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("u", "fresh").orderBy(chance))).where(F.col("r") <= SAMPLE)
    both = taken.select("u", "v", "fresh").unionByName(back.select("u", "v", "fresh")).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    worst = edges.groupBy("u").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    known = codes.join(worst, codes.node == worst.u, "left").select("node", "code", F.when(F.col("n") >= DEGREE, F.col("worst")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
    groups = both.join(known, both.v == known.node).groupBy("u").agg(F.collect_list(F.struct("v", "fresh", "code", "worst")).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = _lists(batch.column("near"))
            ids, fresh = np.asarray(flat.field("v")), np.asarray(flat.field("fresh").cast(pa.int8())).astype(bool)
            worst, x = np.asarray(flat.field("worst")), _bytes_matrix(flat.field("code"), dim)
            sq = (x * x).sum(axis=1)
            found = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                d = sq[a:b, None] + sq[None, a:b] - 2 * (x[a:b] @ x[a:b].T)
                pair = (d < worst[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
                np.fill_diagonal(pair, False)
                i, j = np.nonzero(pair)
                found.append((ids[a + i], ids[a + j], d[i, j]))
            u, v, d = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((d, v, u))  # each better edge once, the best DEGREE of a node
            u, v, d = u[order], v[order], d[order]
            once = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
            u, v, d = u[once], v[once], d[once]
            order = np.lexsort((d, u))
            u, v, d = u[order], v[order], d[order]
            first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
            rank = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
            keep = rank < DEGREE
            yield _edge_batch(u[keep], v[keep], d[keep], np.ones(int(keep.sum()), bool))

    return groups.mapInArrow(run, EDGES), taken.select("u", "v")


def build_graph(nodes: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(codes, edges) of the NN-descent graph over ``nodes``."""
    codes = cut(_quantised(nodes), "ann-codes")
    edges = cut(_best(_first_graph(codes, dim)), "ann-edges")
    total = edges.count()
    for k in range(ROUNDS):
        better, joined = _local_join(edges, codes, dim, k)
        old = edges.join(joined.withColumn("done", F.lit(True)), ["u", "v"], "left")
        old = old.select("u", "v", "d", (F.col("fresh") & F.col("done").isNull()).alias("fresh"))
        before, edges = edges, cut(_best(old.unionByName(better)), "ann-edges")
        remove(nodes.sparkSession, before)
        if edges.where("fresh").count() < STILL * total:
            break
    return codes, edges


def _links(edges: DataFrame) -> DataFrame:
    """Neighbours of each node in searches: its own and the nearest of those that have it as theirs."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("r") <= BACK)
    return edges.select("u", "v").unionByName(back.select("u", "v")).groupBy("u").agg(F.collect_set("v").alias("near"))


_STATE = "query_id long, vector array<double>, found array<struct<node:long,d:double,done:boolean>>"
_FOUND = pa.list_(pa.struct([("node", pa.int64()), ("d", pa.float64()), ("done", pa.bool_())]))


def _starts(queries: DataFrame, codes: DataFrame, dim: int) -> DataFrame:
    """Each query with the nearest of the entry nodes."""
    rows = codes.orderBy(F.xxhash64("node", F.lit(17)), "node").limit(ENTRIES).collect()
    if ENTRIES * (4 * dim + 8) > BROADCAST_BYTES:
        raise ValueError("vectors are too long for the table of entries")
    ids = np.array([r.node for r in rows], np.int64)
    shared = queries.sparkSession.sparkContext.broadcast((ids, _bytes_matrix([bytes(r.code) for r in rows], dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        x = x.astype(np.float64)
        for batch in batches:
            _, flat = _lists(batch.column("vector"))
            q = np.asarray(flat).reshape(batch.num_rows, -1)
            d = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
            near = np.argsort(d, axis=1, kind="stable")[:, :STARTS]
            out = [[{"node": int(ids[j]), "d": float(d[i, j]), "done": False} for j in row] for i, row in enumerate(near.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(out, _FOUND)], ["query_id", "vector", "found"])

    return queries.mapInArrow(run, _STATE)


def _merge(rows: DataFrame, dim: int) -> DataFrame:
    """States with what a hop reached: the BEAM best, nearest first; those expanded are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ends, flat = _lists(batch.column("near"))
            ids = np.asarray(flat.field("v")) if len(flat) else np.zeros(0, np.int64)
            x = _bytes_matrix(flat.field("code"), dim).astype(np.float64) if len(flat) else np.zeros((0, dim))
            vectors = np.asarray(_lists(batch.column("vector"))[1]).reshape(batch.num_rows, -1)
            for k, found in enumerate(batch.column("found").to_pylist()):
                opened = [y["node"] for y in found if not y["done"]][:EXPANDED]
                have = {y["node"]: (y["d"], y["done"] or y["node"] in opened) for y in found}
                a, b = ends[k], ends[k + 1]
                gap = x[a:b] - vectors[k]
                for node, d in zip(ids[a:b].tolist(), (gap * gap).sum(axis=1).tolist(), strict=True):
                    have.setdefault(node, (d, False))
                best = sorted((d, node, done) for node, (d, done) in have.items())[:BEAM]
                out.append([{"node": node, "d": d, "done": done} for d, node, done in best])
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(out, _FOUND)], ["query_id", "vector", "found"])

    return rows.mapInArrow(run, _STATE)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found.

    ``queries`` has query_id and embedding; a row of ``vectors`` whose id is the
    query's is no candidate for it.
    """
    if k >= LISTED:
        raise ValueError(f"k is at most {LISTED - 1}")
    rows, dim = usable(vectors)
    asked, _ = usable(queries.withColumnRenamed("query_id", "vec_id"))
    asked = asked.where(F.size("vector") == dim).select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query_id"])
    spark = vectors.sparkSession
    nodes = cut(nodes_of(rows), "ann-nodes")
    if not nodes.limit(1).count():
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    codes, edges = build_graph(nodes, dim)
    links = cut(_links(edges), "ann-links")
    remove(spark, edges)
    state = cut(_starts(asked, codes, dim), "ann-state")
    nothing = F.array().cast("array<struct<v:bigint,code:binary>>")
    for _ in range(HOPS):
        opened = F.slice(F.filter("found", lambda f: ~f["done"]), 1, EXPANDED)
        front = state.select("query_id", F.explode(opened).alias("f")).select("query_id", F.col("f.node").alias("u"))
        if not front.limit(1).count():
            break
        met = front.join(links, "u").select("query_id", F.explode("near").alias("v")).distinct()
        reached = met.join(codes, met.v == codes.node).groupBy("query_id").agg(F.collect_list(F.struct("v", "code")).alias("near"))
        before, state = state, cut(_merge(state.join(reached, "query_id", "left").withColumn("near", F.coalesce("near", nothing)), dim), "ann-state")
        remove(spark, before)
    remove(spark, links, codes)
    pairs = state.select("query_id", F.col("vector").alias("q"), F.explode("found").alias("f")).select("query_id", "q", F.col("f.node").alias("node"))
    exact = F.sqrt(F.aggregate(F.zip_with("q", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    hits = pairs.join(nodes, "node").select("query_id", exact.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``."""
    return search(vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding"), vectors, k)
