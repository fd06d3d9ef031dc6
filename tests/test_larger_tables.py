"""What makes queries grow no faster than their tables: plans, and results by plain computations."""

import random
import re

from pyspark.sql import functions as F

from finquill.operators import candidates, containment, extract, pages, sequence
from finquill.plans.every import Q
from finquill.sources import steps

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_made_texts_are_not_broadcast(spark, monkeypatch):
    found = Q["field_snippets"](spark, DATA)
    inside = None
    for line in _plan(found).split("\n"):
        depth = len(re.match(r"[ :|+*-]*", line)[0])
        inside = None if inside is not None and depth <= inside else inside
        if "BroadcastExchange" in line and inside is None:
            inside = depth
        assert inside is None or "FileScan" not in line
    want = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(containment, "FEW", 0)  # by parts of the terms
    assert want and sorted(map(tuple, Q["field_snippets"](spark, DATA).collect())) == want
    monkeypatch.setattr(containment, "MANY", 0)
    assert sorted(map(tuple, Q["field_snippets"](spark, DATA).collect())) == want


def test_each_label_is_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def score(label):
        calls.add(1)
        return 90.0 if label == "b" else 10.0

    rows = spark.createDataFrame([(k // 10, k, "abc"[k % 3]) for k in range(300)] + [(99, 1, None)], "doc long, pos long, label string")
    aliases = spark.createDataFrame([("F", "x"), ("G", "y")], "field string, alias string")
    got = {(r.doc, r.pos, r.field) for r in extract.old_matches(rows, aliases, F.udf(score, "double").asNondeterministic()("label")).collect()}
    first = {}
    for k in range(300):
        if k % 3 == 1:
            first.setdefault(k // 10, k)
    assert got == {(d, p, "F") for d, p in first.items()}
    assert calls.value <= 8
    steps.clear(spark)


def test_metadata_reads_only_markup(spark):
    rows = [("d", 1, "Balance Sheet as at March 31, 2024\n| a | b |\n|---|---|\n| auditor's report | 1 |"), ("d", 2, "independent auditor's report"), ("e", 1, None), (None, 1, "")]
    given = spark.createDataFrame(rows, "doc string, page long, text string")
    got = candidates.document_metadata(given)
    assert "MapInArrow" not in _plan(got)
    want = {r.doc: (r.n, r.k) for r in candidates.parse(given).groupBy("doc").agg(F.count("*").alias("n"), F.count_if("rejected").alias("k")).collect()}
    assert {r.doc: (r.pages_processed, r.pages_rejected) for r in got.collect()} == want


def test_header_cells_are_plain_expressions(spark):
    plan = _plan(Q["table_candidates"](spark, DATA))
    assert "exists(array" not in plan
    cells = spark.createDataFrame([("Note No",), ("x",), (None,), ("as at 31st",)], "c string")
    assert [r[0] for r in cells.select(pages.is_header_cell(F.col("c"))).collect()] == [r[0] for r in cells.select(pages.is_header_row(F.array("c"))).collect()]


def test_band_differences(spark):
    r = random.Random(2)
    left = [(k % 40, r.randrange(-60, 60)) for k in range(200)] + [(1, None)]
    right = [(k % 30, r.randrange(-60, 60)) for k in range(60)] + [(100 + k, k - 20) for k in range(40)] * 2 + [(7, None)]
    for width in (1, 5, 8):
        got = sequence.band_differences(spark.createDataFrame(left, "l long, a long"), spark.createDataFrame(right, "r long, b long"), ["l", "r"], "a", "b", width)
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == {(x, y, a - b) for x, a in left for y, b in right if a is not None and b is not None and abs(a - b) < width}
    near = sequence.band_join(spark.range(100).toDF("a"), spark.range(100).toDF("b"), "a", "b", 5)
    assert near.count() == sum(abs(a - b) < 5 for a in range(100) for b in range(100))
