"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the scaled sum of hashed embeddings of the word, its beginnings
and endings.  Filters of several widths run over the whole text, each filter keeps
its TOP largest values (max pooling that can tell one hit from several), and a
dense layer gives the log odds.  The gradient of a maximum touches few places,
so training is cheap.

Training takes a bounded sample of labelled documents (all positive ones count as
much as all negative ones).  Its last fifth, by a hash, is set aside: it chooses the
epoch, one global shift that puts the best decision point at
``DECISION`` (so the score has the same meaning everywhere) and a threshold per
language.  ``score`` uses the text alone; the language column only picks the
threshold of the extra column ``flagged``.

Edge cases: null and empty texts are scored as texts without words; with labels of
one kind or none, every score is the share of positive labels (0 without labels); a
very long text is one pass of its words, in pieces of bounded memory; null ids
are kept and never used for training; repeated rows get equal scores; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import fixed_sample, slices

#: Documents whose prediction is this near their label teach nothing in an epoch.
SURE = 0.01
#: Bound of training in documents, which are taken whole.
TRAIN_ROWS = 6_000
BUCKETS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
TOP = 4
EPOCHS = 6
#: Small samples are gone through more often, up to so many steps.
STEPS = 900
STEMS = (3, 4, 5, 6, 8)
ENDINGS = (4,)
DECISION = 0.7
MEMORY_WORDS = 150_000
PIECE = 1 << 15

_WORD = re.compile(r"\w+")


def _features(word: str) -> list[int]:
    """Buckets of a word, its beginnings (stems) and its endings."""
    n = len(word)
    parts = [f"={word}", *(f"<{word[:k]}" for k in STEMS if k < n), *(f">{word[-k:]}" for k in ENDINGS if k < n)]
    return [zlib.crc32(x.encode("utf-8")) % BUCKETS for x in parts]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Vocabulary:
    """Numbers for words, with the buckets of each."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.buckets: list[list[int]] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        for w in set(words).difference(self.at):
            self.at[w] = len(self.buckets)
            self.buckets.append(_features(w))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def _flat(buckets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in buckets], np.int64)
    return np.fromiter((x for b in buckets for x in b), np.int64, int(sizes.sum())), sizes


class ConvNet:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.03, (BUCKETS, DIM)).astype(np.float32)
        self.conv = [r.normal(0, 0.5 / w**0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.conv_bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.2, FILTERS * TOP * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.shift = 0.0
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}

    def vectors(self, buckets: list[list[int]]) -> np.ndarray:
        flat, sizes = _flat(buckets)
        if not len(sizes):
            return np.zeros((0, DIM), np.float32)
        return np.add.reduceat(self.embed[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes[:, None], dtype=np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """TOP largest values of each filter over a text (0 where there is none above 0), and where they are (-1)."""
        values, places = [], []
        for w, kernel, bias in zip(WIDTHS, self.conv, self.conv_bias, strict=True):
            best, where = np.zeros((TOP, FILTERS), np.float32), np.full((TOP, FILTERS), -1)
            for start in range(0, max(0, len(x) - w + 1), PIECE):
                part = x[start : start + PIECE + w - 1]
                n = len(part) - w + 1
                y = part[:n] @ kernel[0]
                for j in range(1, w):
                    y += part[j : j + n] @ kernel[j]
                y += bias
                if n > TOP:
                    at = np.argpartition(-y, TOP - 1, axis=0)[:TOP]
                    y = np.take_along_axis(y, at, 0)
                else:
                    at = np.broadcast_to(np.arange(n)[:, None], y.shape)
                both, spots = np.concatenate([best, y]), np.concatenate([where, at + start])
                order = np.argsort(-both, axis=0, kind="stable")[:TOP]
                best, where = np.take_along_axis(both, order, 0), np.take_along_axis(spots, order, 0)
            values.append(best.ravel())
            places.append(where)
        return np.concatenate(values), places

    def log_odds(self, x: np.ndarray) -> float:
        return float(self.pooled(x)[0] @ self.out + self.bias[0])

    # -- training ---------------------------------------------------------
    def fit(self, texts: list[str], labels: np.ndarray, languages: list[str | None], seed: int = 2) -> ConvNet:
        positive = float(labels.mean()) if len(labels) else 0.0
        if positive in (0.0, 1.0):
            self.constant = positive
            return self
        r = np.random.default_rng(seed)
        vocabulary = Vocabulary()
        docs = [vocabulary.numbers(words_of(t)) for t in texts]
        held = np.array([zlib.crc32(t.encode("utf-8")) % 5 == 0 for t in texts])
        own, rest = np.flatnonzero(~held), np.flatnonzero(held)
        if len({*labels[rest].tolist()}) < 2:
            rest = own
        flat, sizes = _flat(vocabulary.buckets)
        starts = np.cumsum(sizes) - sizes
        weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive)).astype(np.float32)
        parameters = [*self.conv, *self.conv_bias, self.out, self.bias]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
        e_moment = np.zeros(BUCKETS, np.float32)
        step, best, kept = 0, np.inf, None
        for _ in range(max(EPOCHS, min(50, STEPS // max(1, len(own) // 32)))):
            for batch in np.array_split(r.permutation(own), max(1, len(own) // 32)):
                step += 1
                grads = [np.zeros_like(p) for p in parameters]
                words, pulls = [], []
                for d in batch.tolist():
                    ids = docs[d]
                    distinct, back = np.unique(ids, return_inverse=True)
                    x = self._some(flat, starts, sizes, distinct)[back] if len(ids) else np.zeros((0, DIM), np.float32)
                    pooled, places = self.pooled(x)
                    p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias[0], -30, 30)))
                    if abs(p - labels[d]) < SURE:
                        continue
                    g = weight[d] * (p - labels[d]) / len(batch)
                    back_out = (g * self.out).reshape(len(WIDTHS), TOP, FILTERS)
                    grads[-2] += g * pooled
                    grads[-1] += g
                    for k, w in enumerate(WIDTHS):
                        where = places[k]
                        gk = np.where(where >= 0, back_out[k], 0)
                        grads[len(WIDTHS) + k] += gk.sum(axis=0)
                        if len(x) < w:
                            continue
                        where = np.maximum(where, 0)
                        for j in range(w):
                            grads[k][j] += np.einsum("tf,tfd->df", gk, x[where + j])
                            words.append(ids[where + j].ravel())
                            pulls.append((gk[:, :, None] * self.conv[k][j].T).reshape(-1, DIM))
                for p, gr, (m, v) in zip(parameters, grads, moments, strict=True):
                    m += 0.1 * (gr - m)
                    v += 0.001 * (gr * gr - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if words:  # adaptive steps for the embeddings that took part
                    word = np.concatenate(words)
                    distinct, back = np.unique(word, return_inverse=True)
                    pull = np.zeros((len(distinct), DIM), np.float32)
                    np.add.at(pull, back, np.concatenate(pulls))
                    n = sizes[distinct]
                    ends = np.cumsum(n)
                    own_rows = flat[np.arange(ends[-1]) + np.repeat(starts[distinct] - (ends - n), n)]
                    rows, back = np.unique(own_rows, return_inverse=True)
                    gr = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(gr, back, np.repeat(pull / np.sqrt(n)[:, None], n, axis=0))
                    e_moment[rows] += (gr * gr).mean(axis=1)
                    self.embed[rows] -= 0.05 * gr / np.sqrt(e_moment[rows] + 1e-10)[:, None]
            odds = np.array([self._odds_of(docs[d], flat, starts, sizes) for d in rest.tolist()])
            loss = float((weight[rest] * np.logaddexp(0, np.where(labels[rest] == 1, -odds, odds))).mean())
            if loss < best:
                best, kept = loss, ([p.copy() for p in parameters], self.embed.copy(), odds)
        for p, k in zip(parameters, kept[0], strict=True):
            p[...] = k
        self.embed = kept[1]
        self._calibrate(kept[2], labels[rest], [languages[d] for d in rest.tolist()])
        return self

    def _some(self, flat, starts, sizes, words: np.ndarray) -> np.ndarray:
        n = sizes[words]
        ends = np.cumsum(n)
        rows = flat[np.arange(ends[-1]) + np.repeat(starts[words] - (ends - n), n)]
        return np.add.reduceat(self.embed[rows], ends - n, axis=0) / np.sqrt(n[:, None], dtype=np.float32)

    def _odds_of(self, ids, flat, starts, sizes) -> float:
        distinct, back = np.unique(ids, return_inverse=True)
        return self.log_odds(self._some(flat, starts, sizes, distinct)[back] if len(ids) else np.zeros((0, DIM), np.float32))

    def _calibrate(self, odds: np.ndarray, labels: np.ndarray, languages: list[str | None]) -> None:
        at = _best_cut(odds, labels)
        self.shift = float(np.log(DECISION / (1 - DECISION)) - at)
        for lang in {x for x in languages if x}:
            own = np.array([x == lang for x in languages])
            if len({*labels[own].tolist()}) == 2:
                cut = (_best_cut(odds[own], labels[own]) * own.sum() + at * 50) / (own.sum() + 50)  # few cases stay near the global cut
                self.thresholds[lang] = round(float(1 / (1 + np.exp(-float(cut + self.shift)))), 4)

    # -- scoring ----------------------------------------------------------
    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(x) + self.shift, -30, 30))))


def _best_cut(odds: np.ndarray, labels: np.ndarray) -> float:
    """The cut of the best F1; of equal ones, the middle of the widest gap."""
    order = np.argsort(-odds, kind="stable")
    o, hit = odds[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(o) + 1) + labels.sum())
    gap = o - np.r_[o[1:], o[-1] - 2]
    k = max(np.flatnonzero((f1 >= f1.max() - 1e-12) & (gap > 0)).tolist() or [int(f1.argmax())], key=lambda i: gap[i])
    return float(o[k] - gap[k] / 2)


def train(docs: DataFrame, labels: DataFrame, trainable: Column, rows: int = TRAIN_ROWS) -> ConvNet:
    """A network of at most ``rows`` labelled documents where ``trainable`` (on doc_id) holds."""
    known = labels.where(F.col("toxic").isNotNull() & trainable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = fixed_sample(known, "doc_id", rows, seed=11)
    own = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    got = sorted((r.doc_id, r.text, int(r.toxic), r.lang or "") for r in own.toLocalIterator())
    return ConvNet().fit([g[1] for g in got], np.array([g[2] for g in got], np.float32), [g[3] for g in got])


def score(docs: DataFrame, model: ConvNet) -> DataFrame:
    """doc_id, score, threshold (of the document's language) and flagged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, at = shared.value, {}
        table = np.zeros((0, DIM), np.float32)
        for batch in slices(batches):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            if len(at) > MEMORY_WORDS:
                at, table = {}, table[:0]
            new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in at]
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            table = np.concatenate([table, net.vectors([_features(w) for w in new])])
            out = [net.score(table[np.fromiter(map(at.__getitem__, t), np.int64, len(t))]) for t in texts]
            cut = [net.thresholds.get(x, DECISION) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(cut, pa.float64()), pa.array([s >= c for s, c in zip(out, cut, strict=True)])],
                ["doc_id", "score", "threshold", "flagged"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id long, score double, threshold double, flagged boolean")
