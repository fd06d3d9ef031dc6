"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken in slices of about so many bytes, so that a batch of very
#: long texts needs no more memory than a batch of short ones.
SLICE_BYTES = 4 << 20

#: Nothing above this size is broadcast.
BROADCAST_BYTES = 64 << 20

#: A-Z to a-z, all else as it is: table of ``bytes.translate``.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the checkpoint folder that all executors share.

    The setting ``spark.checkpoint.dir`` is read.  Only where it is unset and the
    master is local (one machine, as in tests) a folder in /tmp takes its place; on a
    cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file:///tmp/finquill-checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Spark's setting to delete shuffle files once the execution that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again.

    The files are committed and shared, so a lost executor costs nothing that
    has been written, and the lineage behind them is gone.  Shuffle files of the step
    go as soon as it is written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, *frames_or_paths: DataFrame | str | None) -> None:
    """Delete what ``cut`` (its own frame) or ``scratch`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for x in frames_or_paths:
        if name := x if isinstance(x, str) else getattr(x, "scratch_path", None):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SLOT: list[tuple[object, object]] = []


def worker_slot(key: object, make: Callable[[], object]) -> object:
    """What ``make`` builds, kept in the Python worker until another key is asked for.

    Workers serve many tasks of many operators; there is one slot, so a worker never holds
    the tables of two operators.
    """
    if not _SLOT or _SLOT[0][0] != key:
        tidy()
        _SLOT.append((key, make()))
    return _SLOT[0][1]


def tidy() -> None:
    """Give memory of the Python worker back to the system."""
    _SLOT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only in glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size_limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` has about ``size_limit`` bytes in each.

    A single text above that size is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > size_limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def utf8(array: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def fixed_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, or all if there are no more, chosen by a hash of ``key``.

    The choice doesn't depend on partitions or order.  One pass counts rows, so
    that the share is known and no task holds the sample.  The share is set a
    little low; the bound holds with all but vanishing probability and the
    final limit makes it certain.
    """
    n = df.count()
    if n <= rows:
        return df
    share = max(0.0, rows / n * (1 - 3 / rows**0.5))
    cells = 1 << 30
    picked = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(cells)) < F.lit(int(share * cells))
    return df.where(picked).limit(rows)
