"""Results that several later steps read, written once to the folder that all executors share.

The files are committed, so a lost executor costs nothing that has been written.  ``clear`` deletes
what a session has written, once its results have been read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[tuple[str, bool]]] = {}


def folder(spark: SparkSession) -> str:
    """The setting spark.checkpoint.dir; only where it is unset on a local master a folder in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file:///tmp/finquill-steps"
    return base.rstrip("/")


def written(df: DataFrame, what: str, result: bool = True) -> DataFrame:
    """``df``, written as Parquet and to be read from there; what is only read on the way to a ``result`` is no result."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append((path, result))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes all that ``written`` wrote in this application; how many results those were."""
    jvm, paths = spark.sparkContext._jvm, _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name, _ in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return sum(result for _, result in paths)
