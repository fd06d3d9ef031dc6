"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are shares and means of a whole text (signs, capitals, repeated words and
lines, lengths).  Training bins each by quantiles, grows trees level by level from
histograms of gradients, and flattens them into arrays; scoring walks all
documents of a slice through a tree at once, one numpy step per level.

Edge cases: null and empty texts have statistics of 0 and get a score; with labels
of one kind or none, every score is the share of positive labels (1 without labels:
nothing is rejected without evidence); very long texts are taken whole; null ids are
kept and never used for training; repeated rows get equal scores; other columns are
ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import fixed_sample, slices, tidy, utf8

#: Bound of the training sample in documents.
TRAIN_ROWS = 8_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
LEAST_LEAF = 8.0
RIDGE = 2.0
DECISION = 0.3

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "share_upper", "share_digit", "share_space", "share_mark", "share_symbol",
    "share_bar", "share_bang", "share_stop", "share_comma", "share_high", "words_upper", "words_repeated", "words_distinct",
    "words_most", "words_short", "words_long", "words_alpha_end", "log_lines", "mean_line", "lines_distinct", "lines_stop", "pairs_distinct", "letter_entropy",
)

_ALL = bytes(range(256))
_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\r",
    "mark": b"!\"'(),-./:;?",
    "symbol": b"#$%&*+<=>@[\\]^_`{|}~",
    "bar": b"|",
    "bang": b"!",
    "stop": b".",
    "comma": b",",
    "high": bytes(range(128, 256)),
}


def statistics(text: bytes) -> list[float]:
    """STATISTICS of a UTF-8 text."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    m = len(words)
    share = {k: (n - len(text.translate(None, s))) / n for k, s in _SETS.items()}
    counts = Counter(words)
    lengths = list(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = letters[letters > 0] / n
    return [
        math.log1p(n),
        math.log1p(m),
        sum(lengths) / m,
        *(share[k] for k in ("upper", "digit", "space", "mark", "symbol", "bar", "bang", "stop", "comma", "high")),
        sum(map(bytes.isupper, words)) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        len(counts) / m,
        max(counts.values()) / m,
        sum(x <= 2 for x in lengths) / m,
        sum(x > 12 for x in lengths) / m,
        sum(w[-1:].isalpha() or w[-1] > 127 for w in words) / m,
        math.log1p(len(lines)),
        n / max(1, len(lines)) / 100,
        len(set(lines)) / len(lines),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        len(set(zip(words, words[1:], strict=False))) / max(1, m - 1),
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Forest:
    """Complete trees as arrays: node k of a tree has children 2k+1 and 2k+2."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1), np.int32))
    split: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << DEPTH)))
    base: float = 0.0
    constant: float | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > split[node])
            total += leaf[node - len(split)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Forest:
        positive = float(y.mean()) if len(y) else 1.0
        if positive in (0.0, 1.0):
            return cls(constant=positive)
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(d)]
        bins = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(d)], axis=1)
        out = cls(base=math.log(positive / (1 - positive)))
        odds = np.full(n, out.base)
        features, splits, leaves = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, split = np.zeros((1 << DEPTH) - 1, np.int32), np.full((1 << DEPTH) - 1, np.inf)
            for level in range(DEPTH):
                width, first = 1 << level, (1 << level) - 1
                own = node - first
                best = np.zeros(width)
                g_all = np.bincount(own, grad, width)
                h_all = np.bincount(own, hess, width)
                c_all = np.bincount(own, minlength=width)
                for k in range(d):
                    size = len(cuts[k]) + 1
                    cell = own * size + bins[:, k]
                    g = np.bincount(cell, grad, width * size).reshape(width, size).cumsum(axis=1)[:, :-1]
                    h = np.bincount(cell, hess, width * size).reshape(width, size).cumsum(axis=1)[:, :-1]
                    c = np.bincount(cell, minlength=width * size).reshape(width, size).cumsum(axis=1)[:, :-1]
                    if not g.shape[1]:
                        continue
                    gain = g**2 / (h + RIDGE) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + RIDGE) - (g_all**2 / (h_all + RIDGE))[:, None]
                    gain[(c < LEAST_LEAF) | (c_all[:, None] - c < LEAST_LEAF)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[first : first + width][better] = k
                    split[first : first + width][better] = cuts[k][at[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > split[node])
            own = node - len(split)
            leaf = RATE * np.bincount(own, grad, 1 << DEPTH) / (np.bincount(own, hess, 1 << DEPTH) + RIDGE)
            odds += leaf[own]
            features.append(feature)
            splits.append(split)
            leaves.append(leaf)
        out.feature, out.split, out.leaf = np.stack(features), np.stack(splits), np.stack(leaves)
        return out


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


def _statistics_of(rows: DataFrame) -> DataFrame:
    """All columns of ``rows`` but text, and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array(_matrix(utf8(batch.column("text"))).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), found], ["doc_id", "quality", "x"])

    return rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, trainable: Column, rows: int = TRAIN_ROWS) -> Forest:
    """Trees from at most ``rows`` labelled documents where ``trainable`` (on doc_id) holds.

    Statistics are computed on the executors; the driver gets numbers only.
    """
    known = labels.where(F.col("quality").isNotNull() & trainable).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    sample = fixed_sample(known.agg(F.max("quality").cast("int").alias("quality")), "doc_id", rows, seed=7)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    got = sorted((r.doc_id, r.quality, r.x) for r in _statistics_of(own).toLocalIterator())
    return Forest.fit(np.array([g[2] for g in got]).reshape(len(got), len(STATISTICS)), np.array([g[1] for g in got], float))


def score(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.score(_matrix(utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Forest, decision: float = DECISION) -> DataFrame:
    """The rows of ``docs``, in their own columns, whose text scores at least ``decision``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.score(_matrix(utf8(batch.column("text")))) >= decision))
        tidy()

    return docs.mapInArrow(run, docs.schema)
