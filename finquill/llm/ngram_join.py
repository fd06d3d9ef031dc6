"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of five words (hashed to 64 bits).  Equal
sets are one node, named by a hash of the set; what is joined are nodes.

1. Counts.  One pass gives every document's node and a count sketch of all shingles
   (2**CELL_BITS cells, whatever the corpus' size).  Rare shingles come first in the
   order of every set.  Any order gives right results; a good one makes short lists.
2. Prefixes.  Two sets that reach the threshold share at least ``l`` of the first
   n - ceil(0.8 n) + l shingles of each, for every l.  Each set chooses the l that
   minimises estimated cost: list entries that it reads, plus verifications, of which
   there are at most (entries / l).  A pair must share min(l, l') shingles of these
   prefixes.  Lists of up to PAIRED nodes are counted pair by pair.
3. Sketches.  A set's parities, by low bits of its shingles, differ from another set's in at
   most as many places as the sets do in shingles.  Pairs whose sketches differ in more than
   a link allows are left out, which loses none; chance meetings, whose number grows with the
   corpus, would else join clusters.  The nodes of a list longer than PAIRED are compared by
   sketches within a task and only edges that join them leave it; one of more than LISTED
   links its nodes to its smallest, unconditionally.  So no list makes a quadratic number of rows.
4. Clusters.  Connected candidates form clusters.  All pairs of a cluster are verified
   exactly where its sets lie together, in chunks of CHUNK nodes: first each chunk with
   itself and with the first one, then, only for clusters of several chunks, those
   chunks that still hold different components.  Only links that join components leave
   a task.
5. Components of links give each document the smallest doc_id that it reaches.

Sets of clusters are computed again from the texts; a filter of fixed size
(2**FILTER_BITS cells) of the documents that are needed spares the others.  Only
tables of a fixed size are broadcast.

Edge cases: null texts and texts without words have an empty set (component_id is the
own doc_id); with one to four words the whole sequence is the only shingle; rows that
repeat a doc_id are given one result each; a null doc_id is never a component's name
unless nothing else is in it; very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import ASCII_LOWER, cut, remove, slices, tidy, utf8
from finquill.llm.components import components

WORDS = 5
#: 100 * intersection >= SHARE * union
SHARE = 80
CELL_BITS = 24
FILTER_BITS = 25
BLOCK_BITS = 16
LEVELS = (1, 2, 3, 4, 6, 8)
PAIRED = 32
LISTED = 4096
#: Least bits of a sketch; one has at least as many as its set has shingles.
SKETCH_BITS = 128
CHUNK = 256
#: Columns of a verification matrix that are in memory at once.
SLAB = 1 << 15
MEMORY_WORDS = 200_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sets of hashed shingles of texts."""

    def __init__(self):
        self.word: dict[bytes, int] = {}

    def set_of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingles (int64)."""
        words = text.translate(ASCII_LOWER).split()
        if not words:
            return np.zeros(0, np.int64)
        memory = self.word
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        k = min(WORDS, len(a))
        n = len(a) - k + 1
        h = np.full(n, np.uint64(k))
        for j in range(k):
            h = (h ^ a[j : j + n]) * _PRIME
            h ^= h >> np.uint64(29)
        return np.unique((h * _MIX).view(np.int64))


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles for each value of their low bits; twice the bits fold to half by exclusive or."""
    bits = max(SKETCH_BITS, 1 << (len(shingles) - 1).bit_length())
    return np.packbits((np.bincount(shingles & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _blocks(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for b, part in enumerate(cells.reshape(-1, 1 << BLOCK_BITS)):
        if part.any():
            yield b, zlib.compress(part.tobytes(), 1)


def _added(blocks: DataFrame, bits: int) -> np.ndarray:
    """Cells (uint16, saturated) summed over all tasks' blocks; fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint8)
                total[b] = np.minimum(total[b].astype(np.uint32) + part, 65535).astype(np.uint16) if b in total else part.astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "cells"])

    out = np.zeros(1 << bits, np.uint16)
    view = out.reshape(-1, 1 << BLOCK_BITS)
    for row in blocks.repartition(1 << max(0, min(6, bits - BLOCK_BITS)), "block").mapInArrow(run, "block int, cells binary").toLocalIterator():
        view[row.block] = np.frombuffer(bytes(row.cells), np.uint16)
    return out


def _survey(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The written survey, whose rows without a block are (doc_id, node, n, sketch) of every row, and the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "node", "n", "sketch", "block", "cells"]
        shingler, cells, seen = Shingler(), np.zeros(1 << CELL_BITS, np.uint8), set()
        for batch in slices(batches):
            nodes, sizes, sketches, held = [], [], [], []
            for text in utf8(batch.column("text")):
                s = shingler.set_of(text)
                node = node_of(s) if len(s) else None
                nodes.append(node)
                sizes.append(len(s))
                sketches.append(sketch(s) if len(s) and node not in seen else None)
                if len(s) and node not in seen:
                    seen.add(node)
                    held.append(s)
            if held:
                at, count = np.unique(np.concatenate(held).view(np.uint64) >> np.uint64(64 - CELL_BITS), return_counts=True)
                at = at.astype(np.int64)
                cells[at] = np.minimum(cells[at].astype(np.int64) + count, 255)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        found = list(_blocks(cells))
        n = len(found)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([b for b, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names)
        del shingler, cells, seen, found
        tidy()

    both = cut(rows.mapInArrow(run, "doc_id long, node long, n long, sketch binary, block int, cells binary"), "shingle-survey")
    return both, _added(both.where("block is not null").select("block", "cells"), CELL_BITS)


def prefix(shingles: np.ndarray, cells: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix shingles of a set, the level of each, and the chosen l."""
    n = len(shingles)
    need = -(-SHARE * n // 100)
    count = cells[(shingles.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.int64)
    base = n - need + 1
    longest = min(n, base + LEVELS[-1] - 1)
    order = np.lexsort((shingles, count))[:longest]
    entries = np.cumsum(np.maximum(count[order] - usual, 0))
    levels = [k for k in LEVELS if k <= need]
    cost = [entries[base + k - 2] * (1 + n / k) + base + k for k in levels]
    best = levels[int(np.argmin(cost))]
    size = base + best - 1
    return shingles[order[:size]], np.maximum(np.arange(size) - base + 2, 1), best


def _lists(rows: DataFrame, cells: np.ndarray) -> DataFrame:
    """(token, node, info) of all prefixes; info packs the set's size, the level and the chosen l.

    A task emits a node once.
    """
    shared = rows.sparkSession.sparkContext.broadcast((cells, float(np.median(cells))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        cells, usual = shared.value
        for batch in slices(batches):
            tokens, nodes, infos = [], [], []
            for text in utf8(batch.column("text")):
                s = shingler.set_of(text)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                token, level, best = prefix(s, cells, usual)
                tokens.append(token)
                nodes.append(np.full(len(token), node))
                infos.append(len(s) << 8 | level << 4 | best)
            if tokens:
                columns = [np.concatenate(tokens), np.concatenate(nodes), np.concatenate(infos).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "node", "info"])
        del shingler, seen
        tidy()

    return rows.mapInArrow(run, "token long, node long, info long")


def _pairs_of(token: np.ndarray, node: np.ndarray, info: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(token, a, b, shared, wanted) from the lists of some tokens; pairs whose sizes rule out a link are left out.

    Pairs have the token 0 and, where they are sure to stand, wanted is 0.  A longer list gives
    (token, node, 0, 0, 1) of its nodes.
    """
    order = np.lexsort((node, token))
    token, node, info = token[order], node[order], info[order]
    once = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
    token, node, info = token[once], node[once], info[once]
    size_of, level, wanted = info >> 8, info >> 4 & 15, info & 15
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    for c in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == c][:, None] + np.arange(c)
        if c > max(PAIRED, LISTED):
            b = node[at[:, 1:]].ravel()
            none = np.zeros(len(b), np.int64)
            yield none, np.repeat(node[at[:, 0]], c - 1), b, none, none
            continue
        if c > PAIRED:
            at = at.ravel()
            none = np.zeros(len(at), np.int64)
            # 0 names no list
            yield np.where(token[at] == 0, 1, token[at]), node[at], none, none, none + 1
            continue
        i, j = np.triu_indices(c, 1)
        i, j = at[:, i].ravel(), at[:, j].ravel()
        least = np.minimum(wanted[i], wanted[j])
        fit = 100 * np.minimum(size_of[i], size_of[j]) >= SHARE * np.maximum(size_of[i], size_of[j])
        good = fit & (level[i] <= least) & (level[j] <= least)
        one = np.ones(int(good.sum()), np.int64)
        yield one - 1, node[i][good], node[j][good], one, least[good].astype(np.int64)


def _met(lists: DataFrame) -> DataFrame:
    """Pairs of short lists, as counted in a task, and nodes of long ones (see ``_pairs_of``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(np.asarray(b.column(c)) for c in ("token", "node", "info")) for b in batches if b.num_rows]
        found = list(_pairs_of(*(np.concatenate(c) for c in zip(*held, strict=True)))) if held else []
        if not found:
            return
        token, a, b, shared, wanted = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((b, a, token))
        token, a, b, shared, wanted = (x[order] for x in (token, a, b, shared, wanted))
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        shared, wanted = (np.add.reduceat(shared, first), np.minimum.reduceat(wanted, first)) if len(a) else (shared, wanted)
        columns = [pa.array(x, pa.int64()) for x in (token[first], a[first], b[first], shared, wanted)]
        yield pa.RecordBatch.from_arrays(columns, ["token", "a", "b", "shared", "wanted"])

    return lists.repartition("token").mapInArrow(run, "token long, a long, b long, shared long, wanted long")


def may_link(n: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` shingles together, of which ``differ`` at least are in one only, can reach the threshold."""
    return (100 + SHARE) * differ <= (100 - SHARE) * n


def joined(nodes: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
    """Edges that join the nodes of which the sketches don't rule a link out."""
    order = np.lexsort((nodes, sizes))
    nodes, sizes = nodes[order], sizes[order]
    words = [np.frombuffer(sketches[k], np.uint64) for k in order]
    forest, edges, width, start, matrix = Forest(), [], 0, 0, None
    for i in range(len(nodes) - 1):
        if len(words[i]) != width:  # sketches grow with sizes: those from here on, folded to this width
            width, start = len(words[i]), i
            last = next((k for k in range(i, len(words)) if len(words[k]) != width), len(words)) - 1
            matrix = np.stack([_folded(w, width) for w in words[i : np.searchsorted(sizes, sizes[last] * 100 // SHARE, side="right")]])
        end = np.searchsorted(sizes, sizes[i] * 100 // SHARE, side="right")
        differ = np.bitwise_count(matrix[i - start] ^ matrix[i + 1 - start : end - start]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(may_link(sizes[i] + sizes[i + 1 : end], differ)) + i + 1
        a = int(nodes[i])
        edges += [(a, b) for b in nodes[near].tolist() if forest.join(a, b)]
    return edges


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches don't rule a link out, and those that are sure."""
    for batch in batches:
        keep = []
        for sure, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("sure", "n", "x", "y")), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            size = min(len(x), len(y))
            keep.append(sure or bool(may_link(n, int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the lists of rows (token, node, n, sketch), ordered by token."""

    def of(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        nodes, sizes, sketches = zip(*held, strict=True)
        edges = joined(np.array(nodes, np.int64), np.array(sizes, np.int64), list(sketches))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    now, held = None, []
    for batch in batches:
        for token, *row in zip(*(batch.column(c).to_pylist() for c in ("token", "node", "n", "sketch")), strict=True):
            if token != now:
                if held:
                    yield of(held)
                now, held = token, []
            held.append(row)
    if held:
        yield of(held)


def _candidates(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose prefixes share enough and whose sketches don't rule a link out, written.

    ``nodes`` has the sketches, once at least for each node.
    """
    spark = lists.sparkSession
    met = cut(_met(lists), "shingle-met")
    pairs = met.where("token = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("wanted").alias("wanted"))
    pairs = cut(pairs.where("shared >= wanted").select("a", "b", (F.col("wanted") == 0).alias("sure")), "shingle-pairs")
    listed = met.where("token <> 0").select("token", F.col("a").alias("node"))
    touched = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(listed.select("node")).distinct()
    known = nodes.where("sketch is not null").join(touched, "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"])
    known = cut(known, "shingle-sketches")
    one, other = known.toDF("a", "na", "x"), known.toDF("b", "nb", "y")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "sure", (F.col("na") + F.col("nb")).alias("n"), "x", "y")
    near = both.mapInArrow(_near, "a long, b long")
    spanned = listed.join(known, "node").repartition("token").sortWithinPartitions("token").mapInArrow(_joined, "a long, b long")
    edges = cut(near.unionByName(spanned), "shingle-candidates")
    remove(spark, met, pairs, known)
    return edges


def _sets_of(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, shingles) of the documents ``needed`` (doc_id), and of a few more.
    """
    mask = np.int64((1 << FILTER_BITS) - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            cells[np.asarray(batch.column("h")) & mask] = 1
        found = list(_blocks(cells))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], ["block", "cells"])

    marks = needed.select(F.xxhash64("doc_id").alias("h")).mapInArrow(mark, "block int, cells binary")
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(_added(marks, FILTER_BITS) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, wanted, seen = Shingler(), np.unpackbits(shared.value), set()
        for batch in slices(batches):
            batch = batch.filter(pa.array(wanted[np.asarray(batch.column("h")) & mask] > 0))
            nodes, sets = [], []
            for text in utf8(batch.column("text")):
                s = shingler.set_of(text)
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])
        del shingler, wanted, seen
        tidy()

    return rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "node long, shingles binary")


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Pairs (i < j, as rows) of sets that reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    token, back = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(back, minlength=len(token)) > 1
    column = np.cumsum(often) - 1
    keep = often[back]
    column, own = column[back[keep]], own[keep]
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + SLAB, SLAB))
    for k, (a, b) in enumerate(pairwise(edges.tolist())):
        m = np.zeros((len(sets), min(SLAB, int(column[-1]) + 1 - k * SLAB)), np.float32)
        m[own[a:b], column[a:b] - k * SLAB] = 1
        common += m @ m.T
    good = np.triu(100 * common >= SHARE * (sizes[:, None] + sizes[None, :] - common), 1)
    return np.argwhere(good)


class Forest:
    """Union-find over the nodes of a task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _verify(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join components within each task key, of rows (key, node, part, shingles)."""

    def of(group: dict[int, tuple[int, bytes]]) -> list[tuple[int, int]]:
        nodes = sorted(group)
        if len(nodes) < 2:
            return []
        forest = Forest()
        first: dict[int, int] = {}
        for x in nodes:  # what is known to be connected isn't linked again
            forest.join(x, first.setdefault(group[x][0], x))
        pairs = linked([np.frombuffer(group[x][1], np.int64) for x in nodes])
        return [(nodes[i], nodes[j]) for i, j in pairs.tolist() if forest.join(nodes[i], nodes[j])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        now, group, links = None, {}, []
        for batch in batches:
            for key, node, part, shingles in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "part", "shingles")), strict=True):
                if key != now:
                    links += of(group)
                    now, group = key, {}
                group[node] = (part, shingles)
            if len(links) > 10_000:
                yield out(links)
                links = []
        yield out(links + of(group))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _tasks(members: DataFrame, chunks: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, part, shingles): each chunk's nodes for each pair of chunks that it is in."""
    sides = pairs.select("cluster", F.col("i").alias("chunk"), "key").unionByName(pairs.where("i <> j").select("cluster", F.col("j").alias("chunk"), "key"))
    return members.join(chunks, "node").join(sides, ["cluster", "chunk"]).select("node", "part", "key").join(sets, "node").select("key", "node", "part", "shingles")


def links_of(rows: DataFrame, nodes: DataFrame, cells: np.ndarray) -> DataFrame:
    """Links (a, b) between nodes that give the components of all links, written."""
    spark = rows.sparkSession
    edges = _candidates(_lists(rows, cells), nodes)
    if not edges.limit(1).count():
        return edges
    found = components(edges)
    clusters = found.select("node", F.col("component").alias("cluster"))
    first = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    needed = cut(clusters.join(first, "node").select("node", "cluster", "doc_id"), "shingle-needed")
    sizes = clusters.groupBy("cluster").count().where(F.col("count") > CHUNK)
    large = cut(sizes.select("cluster", F.ceil(F.col("count") / (CHUNK * 3 // 4)).alias("n")), "shingle-large")
    # a small cluster is a task of its own; its sets are joined and dealt once, nothing is written between
    placed = cut(needed.join(large, "cluster", "left"), "shingle-placed")
    remove(spark, edges, found, needed)
    small = placed.where("n is null")
    own = small.select("node", F.col("cluster").alias("key"), F.col("node").alias("part"))
    links = cut(_verify(_sets_of(rows, small.select("doc_id")).join(own, "node")), "shingle-links")
    if large.limit(1).count():  # of a large one, chunks with themselves and with the first
        chunk = F.pmod(F.xxhash64("node"), F.col("n")).cast("long").alias("chunk")
        spread = cut(placed.where("n is not null").select("node", "cluster", "doc_id", chunk, "n"), "shingle-chunks")
        sets = cut(_sets_of(rows, spread.select("doc_id")).join(spread.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")
        members, where = spread.select("node", "cluster", F.col("node").alias("part")), spread.select("node", "chunk")
        each = large.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
        pairs = each.select("cluster", F.lit(0).cast("long").alias("i"), "j").unionByName(each.where("j > 0").select("cluster", F.col("j").alias("i"), "j"))
        before, links = links, cut(links.unionByName(_verify(_tasks(members, where, pairs.withColumn("key", F.xxhash64("cluster", "i", "j")), sets))), "shingle-links")
        remove(spark, before)
        rest, steps = _rest(spread, links, sets)
        before, links = links, cut(links.unionByName(rest), "shingle-links")
        remove(spark, before, sets, spread, *steps)
    remove(spark, large, placed)
    return links


def _rest(spread: DataFrame, links: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links of large clusters between components that the first chunks left apart; and the steps that they read.

    Nodes are dealt anew: those of a large component to chunks of it, those of all small
    components to common chunks.  Chunks of one large component needn't meet.
    """
    found = components(links.select("a", "b"))
    parts = cut(spread.select("node", "cluster").join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("part")), "shingle-parts")
    size = cut(parts.groupBy("cluster", "part").count().where(F.col("count") > CHUNK // 2).select("cluster", "part", F.ceil(F.col("count") / (CHUNK * 3 // 4)).alias("n")), "shingle-sizes")
    own = parts.join(size, ["cluster", "part"], "left")
    others = cut(own.where("n is null").groupBy("cluster").agg(F.ceil(F.count("*") / (CHUNK * 3 // 4)).alias("m")), "shingle-others")
    dealt = own.join(others, "cluster", "left").select(
        "node", "cluster", "part",
        F.when(F.col("n").isNotNull(), F.col("part")).alias("large"),
        F.pmod(F.xxhash64("node"), F.coalesce("n", "m")).alias("k"),
    ).withColumn("chunk", F.xxhash64(F.coalesce(F.col("large"), F.lit(0)), F.col("large").isNull(), "k"))
    dealt = cut(dealt, "shingle-dealt")
    list_of = dealt.select("cluster", "chunk", "large").distinct()
    a, b = list_of.select("cluster", F.col("chunk").alias("i"), F.col("large").alias("x")), list_of.select("cluster", F.col("chunk").alias("j"), F.col("large").alias("y"))
    pairs = a.join(b, "cluster").where("i <= j and not coalesce(x = y, false)").select("cluster", "i", "j").withColumn("key", F.xxhash64("cluster", "i", "j"))
    return _verify(_tasks(dealt.select("node", "cluster", "part"), dealt.select("node", "chunk"), pairs, sets)), [found, parts, size, others, dealt]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey, cells = _survey(rows)
    nodes = survey.where("block is null").select("doc_id", "node", "n", "sketch")
    links = links_of(rows, nodes, cells)
    found = components(links)
    named = nodes.drop("sketch").join(found, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("class"))
    named = cut(named, "shingle-classes")
    remove(spark, survey, links, found)
    least = cut(named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1"), "shingle-least")
    return named.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; in their own columns.

    Repeated rows are all kept or all dropped, as they share their doc_id; rows with a null doc_id stay.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = cut(gone, "shingle-gone")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # columns of any name are safe within a struct
    return row.join(gone, F.col("row.doc_id") == gone["_gone"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
