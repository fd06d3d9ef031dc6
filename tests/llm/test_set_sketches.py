"""Sketches of shingle sets: chance meetings don't join clusters, and no link is lost."""

import numpy as np
import pytest

pytest.importorskip("finquill.llm")

from finquill.llm import ngram_join  # noqa: E402


def _sets():
    """60 sets that share 20 shingles of about 200, the last ten near copies of the first; one of them of another sketch size."""
    r = np.random.default_rng(3)
    common = r.integers(-(1 << 62), 1 << 62, 20)
    sets = [np.unique(np.r_[common, r.integers(-(1 << 62), 1 << 62, 150 + k % 5 * 40)]) for k in range(50)]
    near = np.unique(np.r_[common, r.integers(-(1 << 62), 1 << 62, 232)])
    return [*sets, near, *(np.unique(np.r_[near[k:], r.integers(-(1 << 62), 1 << 62, 2 * k)]) for k in range(1, 10))]


def test_a_long_list_joins_only_what_may_link(spark):
    sets = _sets()
    assert len({len(ngram_join.sketch(s)) for s in sets[50:]}) == 2
    info = [len(s) << 8 | 1 << 4 | 1 for s in sets]
    lists = spark.createDataFrame([(7, k, i) for k, i in enumerate(info)], "token long, node long, info long")
    nodes = spark.createDataFrame([(k, k, len(s), bytearray(ngram_join.sketch(s))) for k, s in enumerate(sets)], "doc_id long, node long, n long, sketch binary")
    for listed in (lists, lists.where("node % 3 < 2 and node >= 30")):  # a long list and one counted pair by pair
        here = {r.node for r in listed.collect()}
        edges = {(r.a, r.b) for r in ngram_join._candidates(listed, nodes).collect()}
        forest = ngram_join.Forest()
        for a, b in edges:
            forest.join(a, b)
        linked = {(i, j) for i, j in ngram_join.linked(sets).tolist() if i in here and j in here}
        assert linked and all(forest.root(i) == forest.root(j) for i, j in linked)
        assert all(a >= 50 and b >= 50 for a, b in edges)  # chance meetings are left out


def test_sketches_never_rule_a_link_out():
    r = np.random.default_rng(4)
    for n in (1, 5, 100, 127, 128, 129, 1000, 5000):
        a = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        for gone in {0, n // 10, n // 9, n // 5}:
            b = np.unique(np.r_[a[gone:], r.integers(-(1 << 62), 1 << 62, n // 20)])
            if len(b) and len(ngram_join.linked([a, b])):
                assert len(ngram_join.joined(np.array([1, 2]), np.array([len(a), len(b)]), [ngram_join.sketch(a), ngram_join.sketch(b)])) == 1
