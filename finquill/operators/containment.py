"""Texts that contain terms, without comparing every text with every term.

Every text has the keys of its q-grams; a term is looked up by one of its own, the one that
the fewest texts have, so a common word costs no more than the rarest part of the term.  What is
found is verified, so results are exact.  Terms shorter than GRAM are looked up by
themselves; the empty term, which every text contains, meets the texts by SALTS keys.

Null texts contain nothing and null terms are in nothing; repeated terms count once; texts are
told apart by their key columns and repeated keys with equal texts give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, SALTS = 3, 32
#: So many terms are looked up in every text as they are; so many have their parts broadcast (some 10 MB).
FEW, MANY = 64, 100_000


def _grams(text: Column, n: int) -> Column:
    last = F.char_length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, keys: list[str], text: str, terms: DataFrame, term: str, n_terms: int | None = None) -> DataFrame:
    """(keys, ``term``) of all pairs of which the text contains the term, as they are spelled.

    ``n_terms`` says how many terms there are at most, where that is known.  Spark's own guess of the size of texts
    that are made by expressions is far too low, so no join here may broadcast them or their parts.
    """
    if n_terms is not None and n_terms <= FEW:
        return _few(texts, keys, text, terms, term)
    known = terms.select(F.col(term).alias("__needle")).where("__needle is not null").distinct()
    own, same = [f"__k{i}" for i in range(len(keys))], [f"__j{i}" for i in range(len(keys))]
    hay = texts.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(text).alias("__hay")).where("__hay is not null").distinct()
    salt = F.array(F.concat(F.lit("\0"), F.pmod(F.xxhash64("__hay"), F.lit(SALTS)).cast("string")))
    places = hay.select(*own, F.explode(F.concat(salt, *[_grams(F.col("__hay"), n) for n in range(1, GRAM + 1)])).alias("__gram"))
    often = places.groupBy("__gram").agg(F.count("*").alias("__n"))

    length = F.char_length("__needle")
    parts = F.when(length >= GRAM, _grams(F.col("__needle"), GRAM)).otherwise(F.array("__needle"))
    cut = known.where("__needle <> ''").select("__needle", F.size(parts).alias("__parts"), F.explode(parts).alias("__gram"))
    # a term with a part that no text has is in none
    signed = cut.join(often, "__gram").groupBy("__needle").agg(F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram"), F.count("*").alias("__found"), F.first("__parts").alias("__parts"))
    empty = known.where("__needle = ''").select("__needle", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.concat(F.lit("\0"), k.cast("string")))).alias("__gram"))
    lookup = signed.where("__found = __parts").select("__needle", "__gram").unionByName(empty)

    if n_terms is not None:
        lookup = F.broadcast(lookup) if n_terms <= MANY else lookup.hint("merge")
    near = places.join(lookup, "__gram").select(*[F.col(o).alias(s) for o, s in zip(own, same, strict=True)], "__needle")
    on = [F.col(o).eqNullSafe(F.col(s)) for o, s in zip(own, same, strict=True)]
    met = hay.join(near if n_terms is None else near.hint("merge"), on).where(F.contains(F.col("__hay"), F.col("__needle")))
    return met.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col("__needle").alias(term)).distinct()


def _few(texts: DataFrame, keys: list[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    known = terms.where(F.col(term).isNotNull()).groupBy().agg(F.collect_set(term).alias("__needles"))
    rows = texts.select(*keys, F.col(text).alias("__hay")).where("__hay is not null").join(F.broadcast(known), F.lit(True))
    found = F.filter("__needles", lambda n: F.contains(F.col("__hay"), n))
    return rows.select(*keys, F.explode(found).alias(term)).distinct()


def both_ways(labels: DataFrame, label: str, terms: DataFrame, term: str) -> DataFrame:
    """(label, term) of all different pairs of which one contains the other."""
    one = labels.select(label).distinct()
    other = terms.select(term).distinct()
    inside = containing(one, [label], label, other, term, other.count())
    around = containing(other, [term], term, one, label)
    return inside.select(label, term).unionByName(around.select(label, term)).distinct()
