"""Recall of fuzzy lines against edit similarity of all pairs."""

import random

from finquill.llm import line_dedup


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_that_differ_in_one_word(spark):
    r = random.Random(4)

    def word():
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    pairs = []
    for n in [2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 20, 31, 40, 60] * 6:
        a = [word() for _ in range(n)]
        k, how = r.randrange(n), len(pairs) % 3
        b = a[:k] + ([word()] if how == 0 else [] if how == 1 else [word(), a[k]]) + a[k + 1 :]
        if r.random() < 0.2:
            b = a[:k] + [a[k][:-1] + "#"] + a[k + 1 :]
        a, b = " ".join(a), " ".join(b)
        if _distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * k + j, x) for k, p in enumerate(pairs) for j, x in enumerate(p)], "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.line_report(docs).where("n_removed > 0").collect()}
    assert len(pairs) > 50 and got == set(range(1, 2 * len(pairs), 2))


def test_groups_of_a_large_block_are_joined_before_their_lines_meet(spark, monkeypatch):
    r = random.Random(7)

    def words(n):
        return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n)]

    passage, families, copies = words(8), [words(23) for _ in range(3)], 40
    lines = []
    for k in range(copies):
        for family in families:
            own = list(family)
            own[k % 20] = words(1)[0]
            lines.append(" ".join(own + passage))
    sizes, plain = [], line_dedup._verified

    def verified(pairs, texts, what):
        if what != "line-stars":
            sizes.append(pairs.count())
        return plain(pairs, texts, what)

    monkeypatch.setattr(line_dedup, "_verified", verified)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.line_report(docs).where("n_removed > 0").collect()}
    assert got == set(range(3, 3 * copies))
    assert sum(sizes) < 10 * len(lines)  # all pairs of two families are 1,560


def test_strays_that_share_many_blocks_meet_once(spark):
    r = random.Random(11)
    keys = list(range(40))
    blocks = {b: r.sample(keys, 25) for b in range(6)}
    strays = {b: set(r.sample(x, 15)) for b, x in blocks.items()}
    members = spark.createDataFrame([(b, k) for b, x in blocks.items() for k in x], "block long, key long")
    stray = spark.createDataFrame([(b, k) for b, x in strays.items() for k in x], "block long, key long")
    parts = spark.createDataFrame([(k, 50, 9, 0, k // 2) for k in keys], "key long, n int, words int, s long, part long")
    want = {(a, b) for x, y in blocks.items() for a in y for b in y if a < b and a // 2 != b // 2 and (a in strays[x] or b in strays[x])}
    got = [(p.a, p.b) for p in line_dedup._meetings(members, stray, parts).collect()]
    assert len(got) == len(set(got)) and set(got) == want
