"""Files as tables: uploads, zip members, registries, workbooks and page texts.

All readers go through Spark's file sources, so any store that Spark reads will do;
what needs a parser (zip, xlsx) gets whole small files from ``binaryFile``.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finquill.errors import UnsupportedFormat

# File endings that are taken.
SUPPORTED = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".zip")

REGISTRY = "company_slug string, display_name string, created_at string, doc_id string, filename string, stored_name string, size_bytes bigint, sha256 string, uploaded_at string, entity_type string, start_page int, end_page int, notes string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256 and error code of every file below a folder; nothing but the hash needs the content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    error = F.when(~suffix(F.col("path")).isin(*SUPPORTED), "unsupported_format").when(F.col("length") == 0, "empty_document")
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"), error.alias("error_code"))


_MEMBERS = "path string, member string, content binary, error_code string"


def zip_members(archives: DataFrame) -> DataFrame:
    """(path, member, content, error_code) of supported, non-empty members; nested archives are left out.

    An archive that can't be read, or has no such member, is one row with the code unsupported_format.
    """

    def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                name = info.filename.lower()
                if not info.is_dir() and info.file_size and name.endswith(SUPPORTED) and not name.endswith(".zip"):
                    yield info.filename, z.read(info)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path, member, content, code):
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member], pa.string()), pa.array([content], pa.binary()), pa.array([code], pa.string())], ["path", "member", "content", "error_code"])

        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                n = 0
                try:
                    for member, content in members(raw or b""):
                        n += 1
                        yield row(path, member, content, None)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    yield row(path, None, None, UnsupportedFormat.code)
                    n += 1
                if not n:
                    yield row(path, None, None, UnsupportedFormat.code)

    return archives.select("path", "content").mapInArrow(run, _MEMBERS)


def registry(spark: SparkSession, path: str | None) -> DataFrame:
    """The registry of documents; empty if there is none (also at ``path``), lines that can't be read are left out."""
    there = path and spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there is None or not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).option("mode", "DROPMALFORMED").json(path)


def page_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, page, text) from texts with === Page N === markers."""
    parts = texts.select("doc_id", F.explode(F.split("text", r"(?=\n?=== Page \d+ ===)")).alias("part"))
    page = F.regexp_extract("part", r"=== Page (\d+) ===", 1)
    return parts.where(page != "").select("doc_id", page.cast("int").alias("page"), F.regexp_replace("part", r"^\n?=== Page \d+ ===\n?", "").alias("text"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def cells_of(content: bytes) -> list[tuple[str, str, str | None, str | None]]:
    """(sheet part, cell, value, formula) of an xlsx file, with the standard library."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        for name in sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet")):
            for c in ElementTree.fromstring(z.read(name)).iter(f"{{{_NS['m']}}}c"):
                v, f, inline = c.find("m:v", _NS), c.find("m:f", _NS), c.find("m:is", _NS)
                value = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else None if v is None else v.text
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                out.append((name.rsplit("/", 1)[1].removesuffix(".xml"), c.get("r"), value, None if f is None else f.text))
    return out


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, cell, value, formula) of xlsx files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = cells_of(raw or b"")
                except (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, KeyError, ValueError):
                    found = []  # no workbook, no cells
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), *(pa.array(c, pa.string()) for c in columns)], ["path", "sheet", "cell", "value", "formula"])

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, cell string, value string, formula string")
