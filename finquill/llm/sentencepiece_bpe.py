"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes words (a run of word-start marks and what follows it).  The
distinct words of a slice lie one after the other in a flat numpy array of
symbols.  Each round looks up the rank of every neighbouring pair, takes the
segmented minimum per word, merges and compacts, until no pair is left:

* the leftmost pair of minimum rank is always merged;
* further pairs of that same rank are merged in the same round, leftmost first,
  where no longer piece that contains the new piece ranks as well or better, for
  then the order of these merges can't matter.

Words are independent because no piece has a word-start mark after another
character; a vocabulary with such a piece is taken as one word per text.
Results equal those of the sentencepiece library (BPE, byte fallback, identity
normalisation).

Edge cases: null or empty texts give no ids and decode to the empty text; very
long texts and words need memory in proportion to their length; repeated rows
give repeated results; null ids of rows are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from finquill.llm.common import BROADCAST_BYTES, slices, worker_slot

MARK = "▁"
UNKNOWN, CONTROL, BYTE = 2, 3, 6  # kinds of pieces in the model file
#: Distinct words that a worker remembers, and their characters; then the memory is emptied.
MEMORY_WORDS, MEMORY_CHARACTERS = 200_000, 4_000_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: After so many rounds the few words left (long runs) are finished by a heap, which makes
#: the same merges in the same order; rounds alone would take quadratic time there.
ROUNDS = 400
NO_PAIR = np.int64(1 << 40)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield number, data[at : at + size]
            at += size


class Model:
    """A SentencePiece BPE vocabulary with its tables for merging."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        self.dummy_prefix = True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only identity normalisation is supported")
                if spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("extra white space must be kept and escaped")
                self.dummy_prefix = bool(spec.get(3, 1))
        self.kinds = np.array(kinds)
        self.id_of = {p: i for i, p in enumerate(self.pieces) if kinds[i] not in (UNKNOWN, CONTROL, BYTE)}
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(self.pieces):
            if kinds[i] == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        order = sorted({-scores[i] for i in self.id_of.values()})
        dense = {s: r for r, s in enumerate(order)}
        self.rank = np.full(len(self.pieces), NO_PAIR, np.int64)
        for i in self.id_of.values():
            self.rank[i] = dense[-scores[i]]
        n = self.n = len(self.pieces)
        keys: list[int] = []
        merged: list[int] = []
        best_outer = np.full(n, NO_PAIR, np.int64)
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                left, right = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                # what grows a piece may itself not be in the vocabulary's reach yet; being strict is safe
                for part in (left, right):
                    if part is not None:
                        best_outer[part] = min(best_outer[part], self.rank[i])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    merged.append(i)
        at = np.argsort(keys)
        self.pair_keys, self.pair_ids = np.array(keys, np.int64)[at], np.array(merged, np.int32)[at]
        self.pair_dict = dict(zip(keys, merged, strict=True))
        #: all pieces that contain this one at an end rank strictly worse
        self.calm = best_outer > self.rank
        self.split = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        for i in np.flatnonzero(self.kinds == CONTROL):
            self.surface[i] = ""
        for i in np.flatnonzero(self.kinds == UNKNOWN):
            self.surface[i] = " ⁇ "
        self.last_control = max(np.flatnonzero(self.kinds == CONTROL).tolist(), default=-1)
        self.surface_bytes = [s.encode("utf-8") for s in self.surface]
        for b in range(256):
            if self.byte_ids[b]:
                self.surface_bytes[self.byte_ids[b]] = bytes([b])
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])
        self.surface_len = np.array([len(x) for x in self.surface_bytes], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.surface_flat = np.frombuffer(b"".join(self.surface_bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.word_at: dict[str, int] = {}
        self.held = 0
        self.word_len = np.zeros(0, np.int64)
        self.word_ids = np.zeros(0, np.int32)

    # -- encoding ---------------------------------------------------------
    def _char_ids(self, codes: np.ndarray) -> np.ndarray:
        """Ids of characters; those not in the vocabulary as -1 - code point."""
        ids = np.full(int(codes.max(initial=0)) + 1, NO_PAIR)
        ids[codes] = 0
        seen = np.flatnonzero(ids == 0)
        ids[seen] = [self.id_of.get(chr(c), -1 - c) for c in seen.tolist()]
        return ids[codes]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece of each symbol with the next one of its word (-1: none), and its rank."""
        left, right = symbols[:-1], symbols[1:]
        out = np.full(len(symbols), -1, np.int64)
        may = np.flatnonzero((word[:-1] == word[1:]) & (left >= 0) & (right >= 0))
        key = left[may] * self.n + right[may]
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        hit = self.pair_keys[at] == key
        out[may[hit]] = self.pair_ids[at[hit]]
        return out, np.where(out >= 0, self.rank[out], NO_PAIR)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words after all merges, one word after the other, and how many each word has."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols, word = self._char_ids(codes), np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_word = [], []
        for rounds in range(1 << 62):
            if not len(symbols):
                break
            merged, rank = self._pairs(symbols, word)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(symbols)])
            busy = least < NO_PAIR
            if not busy.all():  # finished words leave
                stay = np.repeat(busy, sizes)
                done_symbols.append(symbols[~stay])
                done_word.append(word[~stay])
                symbols, word, merged, rank = symbols[stay], word[stay], merged[stay], rank[stay]
                least, sizes = least[busy], sizes[busy]
                if not len(symbols):
                    break
            if rounds >= ROUNDS:
                for w in np.unique(word).tolist():
                    out = self._by_heap(symbols[word == w].tolist())
                    done_symbols.append(np.array(out, np.int64))
                    done_word.append(np.full(len(out), w))
                break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            own, new = word[at], merged[at]
            leftmost = np.r_[True, own[1:] != own[:-1]]
            # in a run of overlapping pairs (aaa) every other one is merged
            run = np.cumsum(np.r_[True, (np.diff(at) != 1) | leftmost[1:]]) - 1
            in_run = np.arange(len(at)) - np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[run]
            take = leftmost | (self.calm[new] & (in_run % 2 == 0))
            at, new = at[take], new[take]
            symbols[at] = new
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._bytes_of(symbols[order], word[order], len(words))

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """The same merges one by one: best rank first, leftmost first."""
        n, pairs = len(symbols), self.pair_dict
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and symbols[i] >= 0 and symbols[j] >= 0:
                new = pairs.get(symbols[i] * self.n + symbols[j])
                if new is not None:
                    heapq.heappush(heap, (int(self.rank[new]), i, symbols[i], symbols[j], new))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def _bytes_of(self, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: what isn't in the vocabulary goes as its UTF-8 bytes."""
        odd = np.flatnonzero(symbols < 0)
        if len(odd):
            distinct, back = np.unique(symbols[odd], return_inverse=True)
            parts = [self.byte_ids[list(chr(-1 - s).encode("utf-8"))] for s in distinct.tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[odd] = np.array([len(x) for x in parts])[back]
            symbols, word = np.repeat(symbols, sizes), np.repeat(word, sizes)
            symbols[symbols < 0] = np.concatenate([parts[k] for k in back.tolist()])
        return symbols.astype(np.int32), np.bincount(word, minlength=n_words)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        cutter = re.compile(" +[^ ]*|[^ ]+") if self.split else re.compile("(?s).+")
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                if MARK in text:
                    text = text.replace(MARK, " ")
                found = cutter.findall(" " + text if self.dummy_prefix else text)
                counts[i] = len(found)
                words += found
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.word_at) > MEMORY_WORDS or self.held > MEMORY_CHARACTERS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.word_at]
        if new:
            ids, sizes = self.merge_words(new)
            base = len(self.word_at)
            self.held += sum(map(len, new))
            self.word_at.update(zip(new, range(base, base + len(new)), strict=True))
            self.word_len = np.r_[self.word_len, sizes]
            self.word_ids = np.r_[self.word_ids, ids]
        start = np.cumsum(self.word_len) - self.word_len
        at = np.fromiter(map(self.word_at.__getitem__, words), np.int64, len(words))
        size = self.word_len[at]
        ends = np.cumsum(size)
        flat = self.word_ids[np.arange(ends[-1]) + np.repeat(start[at] - (ends - size), size)]
        text_ends = np.r_[0, ends][np.cumsum(counts)]
        return flat, np.diff(np.r_[0, text_ends])

    # -- decoding ---------------------------------------------------------
    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that lie one after the other; ``ends`` starts with 0.

        Pieces' bytes are gathered at once; where control ids or bytes that are no
        UTF-8 occur, texts are decoded one by one.
        """
        plain = not (len(flat) and flat.min() <= self.last_control)
        if plain:
            size, at = self.surface_len[flat], self.surface_at[flat]
            if self.dummy_prefix:  # the mark of a first piece is the space that encoding put there
                first = ends[:-1][ends[1:] > ends[:-1]]
                first = first[self.marked[flat[first]]]
                size[first] -= 1
                at[first] += 1
            after = np.cumsum(size)
            data = self.surface_flat[np.arange(after[-1] if len(after) else 0) + np.repeat(at - (after - size), size)]
            offsets = np.r_[0, after][ends]
            if offsets[-1] < 1 << 31:
                out = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
                try:
                    out.validate(full=True)
                    return out
                except pa.ArrowInvalid:
                    pass
        ids = flat.tolist()
        return pa.array([self.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one each."""
        if not ids:
            return ""
        try:
            if min(ids) <= self.last_control:  # such an id ends a run of bytes
                text = self._decode_broken(ids)
            else:
                text = b"".join(map(self.surface_bytes.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), 0)
        return text[1:] if self.dummy_prefix and self.marked[first] else text

    def _decode_broken(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + size]).decode("utf-8"))
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                held += self.surface_bytes[i]
            else:
                flush()
                out.append(self.surface[i])
        flush()
        return "".join(out)


def _model(data: bytes) -> Model:
    """The worker's own copy; workers serve many tasks."""
    return worker_slot(("sentencepiece", hashlib.sha256(data).hexdigest()), lambda: Model(data))


def read_model(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > BROADCAST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {BROADCAST_BYTES} are sent to executors")
    return data


def encode_decode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text of these ids) of every whole text.

    The vocabulary file is read on the driver and sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in slices(batches, "text", SLICE):
            flat, counts = model.encode(batch.column("text").to_pylist())
            ends = np.r_[0, np.cumsum(counts)]
            decoded = model.decode_all(flat, ends)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
