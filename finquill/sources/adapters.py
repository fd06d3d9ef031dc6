"""Hooks for services that read pages or fields; the engine itself calls none.

An adapter is any picklable callable; it runs in Arrow batches on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquill.errors import DocumentError, QuotaExceeded


class OcrAdapter(Protocol):
    """The texts of a file's pages, first to last."""

    def __call__(self, path: str, content: bytes) -> list[str]: ...


class FieldAdapter(Protocol):
    """Values of the fields asked for, as JSON, from a text."""

    def __call__(self, fields: list[str], text: str) -> str: ...


def with_retries(call: Callable, tries: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again after delays that grow linearly; a used-up quota isn't tried again."""

    def tried(*args):
        for attempt in range(tries):
            try:
                return call(*args)
            except QuotaExceeded:
                raise
            except Exception:
                if attempt + 1 == tries:
                    raise
                sleep(delay * (attempt + 1))

    return tried


_IMAGES = (".png", ".jpg", ".jpeg", ".tiff", ".tif")


def read_pages(files: DataFrame, adapter: OcrAdapter, start_page: int = 1) -> DataFrame:
    """(path, page, text, error_code) of files (path, content): pages count from 1, those before ``start_page`` are left out.

    An image is page 1 whatever the start.  A file that can't be read is one row with a code.
    """
    if start_page < 1:
        raise ValueError("start_page is at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                first = 1 if path.lower().endswith(_IMAGES) else start_page
                try:
                    rows = [(path, n, t, None) for n, t in enumerate(adapter(path, content), 1) if n >= first]
                except DocumentError as e:
                    rows = [(path, None, None, e.code)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["path", "page", "text", "error_code"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error_code string")


def markdown(pages: DataFrame) -> DataFrame:
    """One text a file, its pages in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.where("error_code is null").groupBy("path").agg(F.array_join(ordered, "\n\n").alias("markdown"))
