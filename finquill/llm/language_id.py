"""Language identification as inference of a mixture of languages.

Training takes a bounded sample of labelled texts and estimates, per language,
smoothed probabilities of hashed character trigrams of its words.  A word's
likelihood under a language is the product over its trigrams, tempered so that
long words don't drown the rest.

Inference.  Each document is a mixture: expectation-maximisation estimates the
proportions of all languages from its words' likelihoods.  Languages are then
ordered by proportion and the nested sets of the first 1, 2, ... of them are
fitted again; the set with the best penalised likelihood (half the logarithm of the
words for each further language) is selected.  The prediction is the language of the
largest proportion in the selected set, the score that proportion.

The refit is left out only where it provably can't change the choice: the likelihood of
any set is at most that of the full mixture plus a bound on what further steps could add
(words times the logarithm of the largest relative gradient), and if that less the
likelihood of the first language alone is below the penalty, no larger set wins.

Edge cases: null texts and texts without a letter are ``und`` with score 0; with no
labelled text at all, everything is ``und``; ties go to the language that sorts first;
very long texts are taken whole; null ids are kept and never used for training;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import fixed_sample, slices

#: Bound of the training sample in documents, which are taken whole.
TRAIN_ROWS = 3_000
BUCKETS = 1 << 17
SMOOTHING = 0.2
TEMPER = 0.5
STEPS = 12
MEMORY_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letters_of(text: str) -> list[str]:
    """Runs of letters, lower case; signs that only count as numbers (a half, a superscript) are none."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the words (with a border on either side), and the word of each."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(codes == 2) - 1
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = word[:-2] == word[2:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64)[inside] % BUCKETS, word[:-2][inside]


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """How often each bucket occurs in the texts."""
    out, words = np.zeros(BUCKETS), Counter()

    def add() -> None:
        if words:
            grams, word = _trigrams(list(words))
            out[:] += np.bincount(grams, np.array(list(words.values()), float)[word], BUCKETS)
            words.clear()

    for text in texts:
        words.update(letters_of(text))
        if len(words) > MEMORY_WORDS:
            add()
    add()
    return out


class LanguageModel:
    """Log probabilities of trigrams by language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        self._forget()

    def _forget(self) -> None:
        self.word_at: dict[str, int] = {}
        self.likelihood = np.zeros((0, len(self.languages)), np.float32)

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        """From (language, text) pairs."""
        languages = sorted({lang for lang, _ in rows})
        counts = np.zeros((len(languages), BUCKETS))
        for k, lang in enumerate(languages):
            counts[k] = trigram_counts(text for own, text in rows if own == lang)
        return cls.of_counts(languages, counts)

    @classmethod
    def of_counts(cls, languages: list[str], counts: np.ndarray) -> LanguageModel:
        smooth = counts + SMOOTHING
        return cls(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def _word_numbers(self, words: list[str]) -> np.ndarray:
        if len(self.word_at) > MEMORY_WORDS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.word_at]
        if new:
            grams, word = _trigrams(new)
            sums = np.add.reduceat(self.table[grams], np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), axis=0)
            base = len(self.word_at)
            self.word_at.update(zip(new, range(base, base + len(new)), strict=True))
            self.likelihood = np.concatenate([self.likelihood, TEMPER * (sums - sums.max(axis=1, keepdims=True))])
        return np.fromiter(map(self.word_at.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, float]]]]:
        """(language, its proportion, all selected languages with proportions) of each text."""
        out: list[tuple[str, float, list[tuple[str, float]]]] = [(UNKNOWN, 0.0, [])] * len(texts)
        rows, words, sizes = [], [], []
        for i, text in enumerate(texts):
            if text and self.languages and (found := letters_of(text)):
                rows.append(i)
                words += found
                sizes.append(len(found))
        if not rows:
            return out
        key = np.repeat(np.arange(len(rows)) << 32, sizes) + self._word_numbers(words)
        key, count = np.unique(key, return_counts=True)
        doc, word = key >> 32, key & 0xFFFFFFFF
        chosen, share = self._select(np.exp(self.likelihood[word], dtype=np.float64), count.astype(float), doc, len(rows))
        for r, i in enumerate(rows):
            found = sorted(((self.languages[k], round(float(share[r, k]), 6)) for k in np.flatnonzero(chosen[r])), key=lambda x: (-x[1], x[0]))
            out[i] = (*found[0], found)
        return out

    def _fit(self, p: np.ndarray, count: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions by document among its allowed languages, and the log likelihood."""
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        total = np.add.reduceat(count, first)[:, None]
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(STEPS):
            joint = p * share[doc]
            joint *= (count / joint.sum(axis=1))[:, None]
            share = np.add.reduceat(joint, first, axis=0) / total
            share = np.maximum(share, 1e-9) * allowed
            share /= share.sum(axis=1, keepdims=True)
        return share, np.add.reduceat(count * np.log((p * share[doc]).sum(axis=1)), first)

    def _select(self, p: np.ndarray, count: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        full, reach = self._fit(p, count, doc, np.ones((n, p.shape[1])))
        order = np.argsort(-full, axis=1, kind="stable")
        chosen = np.zeros(full.shape)
        chosen[np.arange(n), order[:, 0]] = 1
        share = chosen.copy()
        # what a larger set could gain over the first language alone, at most
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        words = np.add.reduceat(count, first)
        alone = np.add.reduceat(count * np.log(p[np.arange(len(p)), order[doc, 0]]), first)
        gradient = np.add.reduceat(p * (count / (p * full[doc]).sum(axis=1))[:, None], first, axis=0) / words[:, None]
        gain = reach + words * np.log(np.maximum(gradient.max(axis=1), 1.0)) - alone
        mixed = np.flatnonzero(gain >= 0.5 * np.log(words + 1)) if full.shape[1] > 1 else np.zeros(0, np.int64)
        if not len(mixed):
            return chosen, share
        take = np.isin(doc, mixed)
        p, count, own = p[take], count[take], np.searchsorted(mixed, doc[take])
        words = np.bincount(own, count)
        best = np.full(len(mixed), -np.inf)
        allowed = np.zeros((len(mixed), full.shape[1]))
        for k in range(full.shape[1]):
            allowed[np.arange(len(mixed)), order[mixed, k]] = 1
            got, fit = self._fit(p, count, own, allowed)
            fit = fit - 0.5 * k * np.log(words + 1)
            better = fit > best
            best[better] = fit[better]
            chosen[mixed[better]], share[mixed[better]] = allowed[better], got[better]
        return chosen, share


def train(docs: DataFrame, trainable: Column, rows: int = TRAIN_ROWS, seed: int = 5) -> LanguageModel:
    """A model of at most ``rows`` labelled documents, whole; the others teach nothing.

    Trigrams are counted on the executors; the driver gets a table of at most
    BUCKETS numbers a language.
    """
    own = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                found = trigram_counts(t for x, t in zip(langs, texts, strict=True) if x == lang)
                total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            at = np.flatnonzero(found)
            at = at if len(at) else np.zeros(1, np.int64)  # a language whose texts have no letter is one too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(found[at].astype(np.int64))], ["lang", "bucket", "n"])

    counted = fixed_sample(own, "doc_id", rows, seed).mapInArrow(run, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    languages = sorted(langs.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in langs.dictionary.to_pylist()], np.int64)
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        counts[place[np.asarray(langs.indices)], np.asarray(table.column("bucket"))] = np.asarray(table.column("n"))
    return LanguageModel.of_counts(languages, counts)


_MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and mixture (selected languages with proportions) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in slices(batches):
            found = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([[{"lang": lang, "share": s} for lang, s in x[2]] for x in found], _MIX),
                ],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
