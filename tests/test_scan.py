"""Segmented scans against one window a key, and tables that are written anew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finquill.operators import quality, scan, sequence
from finquill.sources import files, sinks


def _rows(spark, n=3000):
    r = random.Random(7)
    keys = ["hot"] * 9 + ["b", None]
    return spark.createDataFrame([(r.choice(keys), r.choice([None, *range(400)]), r.randrange(5), r.choice([None, 1, 2, 3])) for _ in range(n)], "k string, o int, t int, v int").withColumn("id", F.monotonically_increasing_id())


@pytest.mark.parametrize("target", [10, 1_000_000])
def test_scans_against_windows(spark, target):
    rows = _rows(spark)
    w = Window.partitionBy("k").orderBy("o", "t", "id")
    sliced = scan.with_slices(rows, ["k"], "o", target)
    got = scan.with_last(scan.with_previous(sliced, ["k"], "o", ["v", "id"], ["t", "id"]), ["k"], "o", "v", "known", ["t", "id"])
    got = scan.with_total(got, ["k"], {"total": F.col("v"), "n": F.lit(1)})
    whole = Window.partitionBy("k")
    want = rows.withColumns({"__before": F.lag(F.struct("v", "id")).over(w), "known": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("v").over(whole), "n": F.count("*").over(whole)})
    columns = ["k", "o", "t", "v", "id", "__before", "known", "total", "n"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    sizes = {r["k"]: r["m"] for r in sliced.groupBy("k", "__slice").count().groupBy("k").agg(F.max("count").alias("m")).collect()}
    assert target > 3000 or sizes["hot"] < 250  # of about 2,400 rows; nulls of the order make the first slice larger


def test_balances_and_as_of_on_a_hot_key(spark):
    r = random.Random(3)
    rows, balance = [], {"hot": 0, "b": 0}
    for i in range(2000):
        k = "hot" if i % 10 else "b"
        credit, debit = r.randrange(500), r.randrange(500)
        balance[k] += credit - debit + (5000 if r.random() < 0.02 else 0)
        rows.append((k, i, balance[k], credit, debit))
    df = spark.createDataFrame(rows, "account string, idx int, balance int, credit int, debit int")
    few, one = (sorted(map(tuple, quality.balance_progression(df, "account", t).collect())) for t in (50, 10**6))
    assert few == one and 10 < len(one) < 100
    left, right = df.where("idx % 3 = 0").select("account", "idx", "balance"), df.where("idx % 3 = 1").select("account", "idx", "credit")
    few, one = (sorted(map(str, sequence.as_of(left, right, ["account"], "idx", "credit", t).collect())) for t in (50, 10**6))
    assert few == one and len(one) == left.count()
    assert quality.balance_progression(df.limit(0), "account").count() == 0


def test_replace_keeps_the_format_and_recovers(spark, tmp_path):
    df = spark.range(3).toDF("id")
    path = (tmp_path / "cache").as_uri()
    sinks.append(df, path)
    sinks.replace(df.limit(1), path)
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 4
    (tmp_path / "cache").rename(tmp_path / "cache.old")  # as if a replace had ended halfway
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 4 and not sinks.recover(spark, path)


def test_published_versions(spark, tmp_path):
    df = spark.range(3).toDF("id")
    path = (tmp_path / "terms").as_uri()
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    sinks.publish(df, path)
    before = sinks.published(spark, path)
    sinks.publish(df.limit(1), path, "json")
    # a reader that has begun still sees its whole version
    assert before.count() == 3 and sinks.published(spark, path, "id long").count() == 1
    sinks.publish(df.limit(2), path)
    assert sinks.published(spark, path).count() == 2
    assert len([x for x in (tmp_path / "terms").iterdir() if x.name.startswith("v-")]) == 2


def test_registry_that_is_not_there(spark, tmp_path):
    assert files.registry(spark, (tmp_path / "none").as_uri()).count() == 0 and files.registry(spark, None).count() == 0
