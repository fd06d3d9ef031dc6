"""Cross-tokenizer alignment: tokens of two vocabularies over the bytes of one text.

Python only tokenises.  ``tokenise`` gives one row for each slice of documents: the ids and
byte ends of the tokens of A (byte-level BPE, read from a ``tokenizers`` file) and B
(SentencePiece BPE, which puts a space before the text) for each of the slice's distinct pieces,
and each document as an array of pieces with the number of its tokens.  A piece reaches from one space to the next; tokens of
neither side cross from one to the next, so a document's groups and links are those of its
pieces, one after the other.  All else is Spark's higher-order functions over these arrays,
linear in their length:

* if a piece's two arrays of ends are equal, tokens, groups and links go one to one;
* else both arrays of ends, each end packed with its side and place, are sorted into one; an
  element's place there, less its place on its own side, is the number of tokens of the other
  side that ended before it, so each element names one link (a pair of overlapping tokens) or
  closes a group.  No pairs within a group are tried;
* ``sequence``, ``transform`` and ``aggregate`` go through the pieces and put documents together.

Corpus-wide counts: an id pair's count is the number of documents that hold it linked.  Links
meet their counts by a join in two parts: pairs from some count on, at most FREQUENT of
them (that bounds what is broadcast, and takes the hot pairs), by a broadcast; the others
by a shuffle, in which none of them can be hot.  Both parts are exact.

Edge cases: texts null, empty or holding a character that a tokenizer doesn't give back
(U+2581 is a space to B) have no tokens: zeros and an empty digest; they count for no pair.
Repeated rows, ids and null ids are rows of their own.  Very long texts need memory in
proportion to their length.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import cut, remove, slices, worker_slot
from finquill.llm.sentencepiece_bpe import MARK, Model, read_model

#: Bytes of text in a slice (a longer text is one of its own).
SLICE = 4 << 20
#: Characters of text that are cut into pieces at once.
CUT = 1 << 20
#: Distinct pieces between spaces that a worker remembers, and their characters; then the memory is emptied.
MEMORY_PIECES, MEMORY_CHARACTERS = 300_000, 4_000_000
#: New pieces that are tokenised at once.
LEARN = 20_000
#: At most so many id pairs, the most frequent, are broadcast (16 bytes each).
FREQUENT = 1 << 20

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cuts only before a space that follows no white space: neither vocabulary has a token over such a place.
_PIECE = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies print bytes as signs: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary: ids of texts, and how many bytes each id has."""

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without a normaliser and with the usual pattern are supported")
        sign = _byte_of_sign()

        def raw(token: str) -> bytes:
            return bytes(sign[c] for c in token)

        ranks = {bytes([b]): b for b in range(256)}
        ids = {b: model["vocab"][c] for c, b in sign.items()}
        for k, merge in enumerate(model["merges"]):
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            if ranks.setdefault(raw(token), 256 + k) == 256 + k:
                ids[256 + k] = model["vocab"][token]
        self.id_of_rank = np.zeros(256 + len(model["merges"]), np.int32)
        self.id_of_rank[list(ids)] = list(ids.values())
        self.bytes_of = {ids[r]: t for t, r in ranks.items()}
        self.length = np.zeros(max(self.bytes_of) + 1, np.int32)
        self.length[list(self.bytes_of)] = [len(t) for t in self.bytes_of.values()]
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.id_of_rank[self._encoding.encode_to_numpy(text, disallowed_special=())]


class Pair:
    """Both vocabularies, with a memory of the pieces between spaces that were met."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.a, self.b = ByteLevel(a), Model(b)
        if not self.b.dummy_prefix:
            raise ValueError("the second vocabulary must put a space before a text")
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.b_length = self.b.surface_len.astype(np.int32)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        #: 1: can't be given back; 2: white space at its start, so the place before it may be no cut
        self.flags = np.zeros(0, np.int8)

    def _learn(self, pieces: list[str]) -> None:
        """Tokens of pieces, each with a space before it."""
        lengths = np.array([1 + len(p.encode("utf-8")) for p in pieces], np.int64)
        inner = np.array([bool(p) and not p[0].isspace() for p in pieces], bool)
        # pieces that begin with no white space are tokenised as one text and cut again
        text = "".join([" " + p for p, i in zip(pieces, inner.tolist(), strict=True) if i])
        joined = self.a.encode(text) if text else np.zeros(0, np.int32)
        ends = np.cumsum(self.a.length[joined], dtype=np.int64)
        bounds = np.r_[0, np.searchsorted(ends, np.cumsum(lengths[inner]), "right")]
        sizes_a, parts, at = np.zeros(len(pieces), np.int64), [], 0
        sizes_a[inner] = np.diff(bounds)
        for k in np.flatnonzero(~inner).tolist():
            own = self.a.encode(" " + pieces[k])
            upto = int(sizes_a[:k][inner[:k]].sum())
            parts += [joined[at:upto], own]
            sizes_a[k], at = len(own), upto
        ids_a = np.concatenate([*parts, joined[at:]])
        lists = self._sp.encode(pieces, num_threads=1)
        lists = [x if p else [self.b.id_of[MARK]] for x, p in zip(lists, pieces, strict=True)]
        sizes_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes_b.sum()))
        lost = np.array([MARK in p for p in pieces], bool)
        for sizes, ids, length in ((sizes_a, ids_a, self.a.length), (sizes_b, ids_b, self.b_length)):
            total = np.r_[0, np.cumsum(length[ids], dtype=np.int64)][np.r_[0, np.cumsum(sizes)]]
            lost |= np.diff(total) != lengths
        base = len(self.at)
        self.at.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.held += sum(map(len, pieces))
        self.flags = np.r_[self.flags, lost + 2 * ~inner].astype(np.int8)
        for k, (sizes, ids) in enumerate(((sizes_a, ids_a), (sizes_b, ids_b))):
            self.sizes[k], self.ids[k] = np.r_[self.sizes[k], sizes], np.r_[self.ids[k], ids]

    def _places(self, found: list[list[str]]) -> np.ndarray:
        pieces = list(chain.from_iterable(found))
        new = [p for p in dict.fromkeys(pieces) if p not in self.at]
        for k in range(0, len(new), LEARN):
            self._learn(new[k : k + LEARN])
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def _cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces of texts, one after the other, and how many each text has."""
        found = [(t.split(" ") if self.b.split else [t]) if t else [] for t in texts]
        places = self._places(found)
        if self.b.split:
            text_of = np.repeat(np.arange(len(texts)), [len(x) for x in found])
            odd = np.unique(text_of[(self.flags[places] & 2) > 0]).tolist()
            if odd:  # spaces beside white space are no cuts there
                for i in odd:
                    found[i] = [p[1:] for p in _PIECE.findall(" " + texts[i])]
                places = self._places(found)
        return places, np.array([len(x) for x in found], np.int64)

    def tokenise(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Tokens of the distinct pieces, and the pieces of each text (none if it can't be given back)."""
        if len(self.at) > MEMORY_PIECES or self.held > MEMORY_CHARACTERS:
            self._forget()
        parts, counts, start, size = [], [], 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= CUT or i == len(texts) - 1:
                for x, into in zip(self._cut(texts[start : i + 1]), (parts, counts), strict=True):
                    into.append(x)
                start, size = i + 1, 0
        places = np.concatenate([np.zeros(0, np.int64), *parts])
        text_of = np.repeat(np.arange(len(texts)), np.concatenate([np.zeros(0, np.int64), *counts]))
        lost = np.zeros(len(texts), bool)
        lost[text_of[(self.flags[places] & 1) > 0]] = True
        stay = ~lost[text_of]
        distinct, pieces = np.unique(places[stay], return_inverse=True)
        out = {"pieces": pieces.astype(np.int32), "upto": np.cumsum(np.bincount(text_of[stay], minlength=len(texts)))}
        for side, sizes, ids, length in zip("ab", self.sizes, self.ids, (self.a.length, self.b_length), strict=True):
            size, starts = sizes[distinct], np.cumsum(sizes) - sizes
            after = np.cumsum(size)
            flat = ids[np.arange(int(size.sum())) + np.repeat(starts[distinct] - (after - size), size)]
            out |= {f"{side}_ids": flat, f"{side}_ends": np.cumsum(length[flat], dtype=np.int32), f"{side}_upto": after.astype(np.int32)}
        return out


def _pair(a: bytes, b: bytes) -> Pair:
    return worker_slot(("alignment", hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()), lambda: Pair(a, b))


_ITEM = ("a_ids", "a_ends", "b_ids", "b_ends")
TOKENS = f"docs array<struct<doc_id: long, n_a: long, n_b: long, pieces: array<int>>>, items array<struct<{', '.join(f'{c}: array<int>' for c in _ITEM)}>>"


def _one_row(array: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)


def tokenise(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each slice of documents: their pieces, and the tokens of the distinct pieces under both vocabularies.

    ``a_ends`` and ``b_ends`` are byte ends in the text that the distinct pieces, a space before
    each, make together.  The vocabulary files, bounded in size, are read on the driver and
    sent to the executors once.
    """
    context = docs.sparkSession.sparkContext
    shared_a, shared_b = context.broadcast(read_model(a_path)), context.broadcast(read_model(b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(shared_a.value, shared_b.value)
        for batch in slices(batches, "text", SLICE):
            out = both.tokenise(batch.column("text").to_pylist())
            upto = np.r_[0, out["upto"]]
            pieces = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(out["pieces"]))
            of_side = {side: np.r_[0, out[f"{side}_upto"]].astype(np.int32) for side in "ab"}
            sizes = [pa.array(np.diff(np.r_[0, np.cumsum(np.diff(of_side[side])[out["pieces"]])][upto]), pa.int64()) for side in "ab"]
            rows = pa.StructArray.from_arrays([batch.column("doc_id"), *sizes, pieces], ["doc_id", "n_a", "n_b", "pieces"])
            items = [pa.ListArray.from_arrays(pa.array(of_side[c[0]]), pa.array(out[c], pa.int32())) for c in _ITEM]
            yield pa.RecordBatch.from_arrays([_one_row(rows), _one_row(pa.StructArray.from_arrays(items, _ITEM))], ["docs", "items"])

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, TOKENS)


# -- groups and links: higher-order functions only -----------------------------------------

_SIDE = 1 << 31  # bit of a packed end that says B
_PLACE = (1 << 31) - 1
_CLOSE = -(1 << 63)  # bit of what stands after the links of a group


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _packed(ends: Column, side: int) -> Column:
    """Ends as longs that sort by (end, side), with the token's place in the low bits."""
    return F.transform(ends, lambda e, k: F.shiftleft(e.cast("long"), 32).bitwiseOR((k.cast("long") if not side else k.cast("long").bitwiseOR(side))))


def _pair_of(upper: Column, lower: Column) -> Column:
    return F.shiftleft(upper.cast("long"), 32).bitwiseOR(lower.cast("long"))


def _steps(a_ids: Column, a_ends: Column, b_ids: Column, b_ends: Column) -> Column:
    """Links in order, A's id in the upper half of a long and B's in the lower; after the links
    of a group a negative number, whose bits but the first are the tokens of A and B up to there."""

    def step(x: Column, i: Column) -> Column:
        k = x.bitwiseAND(_PLACE).cast("int")
        common = F.get(a_ends, i - k - 1) == F.shiftright(x, 32).cast("int")
        close = _pair_of(i - k, k + 1).bitwiseOR(_CLOSE)
        of_b = F.when(common, close).otherwise(_pair_of(F.get(a_ids, i - k), F.get(b_ids, k)))
        return F.when(x.bitwiseAND(_SIDE) == 0, _pair_of(F.get(a_ids, k), F.get(b_ids, i - k))).otherwise(of_b)

    return F.transform(F.sort_array(F.concat(_packed(a_ends, 0), _packed(b_ends, _SIDE))), step)


def _names(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def _group_texts(closes: Column, a_ids: Column, b_ids: Column) -> Column:
    """Texts ``a1,a2|b1`` of the groups that end at ``closes``; null after the last."""

    def group(start: Column, end: Column) -> Column:
        a, b = F.shiftright(start, 32).bitwiseAND(_PLACE).cast("int"), start.bitwiseAND(_PLACE).cast("int")
        n_a, n_b = F.shiftright(end, 32).bitwiseAND(_PLACE).cast("int") - a, end.bitwiseAND(_PLACE).cast("int") - b
        many = F.concat(_names(F.slice(a_ids, a + 1, n_a)), F.lit("|"), _names(F.slice(b_ids, b + 1, n_b)))
        return F.when(end - start == (1 << 32) + 1, F.concat(F.get(a_ids, a).cast("string"), F.lit("|"), F.get(b_ids, b).cast("string"))).otherwise(many)

    return F.zip_with(F.concat(F.array(F.lit(_CLOSE)), closes), closes, group)


def align(tokens: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, ``groups`` and ``links`` of each document of ``tokenise``.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of decimal ids in order.  ``links`` has one long
    per pair of overlapping tokens in order, A's id in the upper half and B's in the lower.
    """

    def piece(x: Column) -> Column:
        a_ids, a_ends, b_ids, b_ends = (x[c] for c in _ITEM)
        pairs = F.zip_with(a_ids, b_ids, lambda p, q: F.concat(p.cast("string"), F.lit("|"), q.cast("string")))
        one_to_one = F.struct(F.zip_with(a_ids, b_ids, _pair_of).alias("links"), F.array_join(pairs, ";").alias("text"))

        def mixed(s: Column) -> Column:
            text = F.array_join(_group_texts(F.filter(s, lambda y: y < 0), a_ids, b_ids), ";")
            return F.struct(F.filter(s, lambda y: y >= 0).alias("links"), text.alias("text"))

        # equal ends: each token of A is one of B
        return F.when(a_ends == b_ends, one_to_one).otherwise(_let(_steps(a_ids, a_ends, b_ids, b_ends), mixed))

    def document(d: Column) -> Column:
        groups = F.array_join(F.transform(d["pieces"], lambda p: F.get("of", p)["text"]), ";")
        links = F.flatten(F.transform(d["pieces"], lambda p: F.get("of", p)["links"]))
        return F.struct(*(d[c].alias(c) for c in ("doc_id", "n_a", "n_b")), groups.alias("groups"), links.alias("links"))

    # the generator keeps the pieces, used in every document, from being computed there
    rows = tokens.select("docs", F.transform("items", piece).alias("of")).select("*", F.explode(F.array(F.lit(0))).alias("_one"))
    n_links = F.size("links").cast("long")
    return rows.select(F.inline(F.transform("docs", document))).select(
        "doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - n_links).alias("n_groups"), n_links.alias("n_links"), "groups", "links"
    )


# -- corpus-wide counts ----------------------------------------------------------------------


def with_counts(aligned: DataFrame) -> DataFrame:
    """Columns of ``align`` but ``links``, with ``n_best`` and ``count_sum``.

    ``count_sum`` adds the counts of a document's links; ``n_best`` is the number of links
    whose count is the highest that their A id has anywhere, ties included.
    """
    spark = aligned.sparkSession
    rows = cut(aligned.withColumns({"_row": F.monotonically_increasing_id(), "links": F.sort_array("links")}), "alignment")
    pairs = rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counted = cut(pairs, "alignment-counts")
    a = F.shiftright("pair", 32).alias("a")
    most = counted.groupBy(a).agg(F.max("n").alias("most"))  # a row per id of A
    counts = cut(
        counted.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")),
        "alignment-best",
    )
    remove(spark, counted)
    size = F.floor(F.log2("n")).cast("int")
    held, least = 0, 64
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # 63 rows at most
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["size"]
    frequent, rare = F.broadcast(counts.where(size >= least)), counts.where(size < least)
    links = rows.select("_row", F.explode("links").alias("pair"))
    met = links.join(frequent, "pair").select("_row", "n", "best")
    if held > FREQUENT:
        others = links.join(frequent, "pair", "left_anti").groupBy("_row", "pair").agg(F.count("*").alias("times"))
        met = met.unionByName(others.join(rare, "pair").select("_row", (F.col("n") * F.col("times")).alias("n"), (F.col("best") * F.col("times")).alias("best")))
    sums = met.groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("links").join(sums, "_row", "left").drop("_row").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
