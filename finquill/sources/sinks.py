"""Sinks: long tables through Spark's writers; one small workbook from a bounded report."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A workbook is made on the driver, so its rows are bounded; larger tables are written as Parquet or CSV.
WORKBOOK_ROWS = 50_000


def _column(n: int) -> str:
    name = ""
    while n:
        n, k = divmod(n - 1, 26)
        name = chr(65 + k) + name
    return name


def _sheet(rows: list[list[object]]) -> str:
    out = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row, 1):
            ref = f"{_column(c)}{r}"
            if value is None:
                continue
            if isinstance(value, str) and value.startswith("="):
                cells.append(f'<c r="{ref}"><f>{escape(value[1:])}</f></c>')
            elif isinstance(value, int | float) and not isinstance(value, bool):
                cells.append(f'<c r="{ref}"><v>{value!r}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """An xlsx file with a sheet per (ordered) frame; refuses frames above WORKBOOK_ROWS."""
    tables = {}
    for name, df in sheets.items():
        rows = df.limit(WORKBOOK_ROWS + 1).collect()
        if len(rows) > WORKBOOK_ROWS:
            raise ValueError(f"{name} has more than {WORKBOOK_ROWS} rows; write it as Parquet or CSV")
        tables[name] = [list(df.columns), *(list(r) for r in rows)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(tables) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(tables, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(tables.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows))
    return buffer.getvalue()


def markdown_lines(df: DataFrame) -> DataFrame:
    """Table rows as Markdown lines (column ``value``) for ``write.text``."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("value"))


def document_sheets(kind: str, summary: DataFrame, rows: DataFrame, issues: DataFrame, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Sheets of one document's workbook, in order: summary, its rows under the name of its kind, tables, checks."""
    names = {"bank_statement": "Transactions", "financial_report": "Report Metrics"}
    sheets = {"Document Summary": summary, names.get(kind, "Line Items"): rows}
    sheets |= {f"Table {k}": t for k, t in enumerate((tables or {}).values(), 1)}
    return sheets | {"Validation Report": issues}


def append(df: DataFrame, path: str) -> None:
    """Rows of a cache or of learned terms added to those there are."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """A small table at a path of its own written anew, in the format it has (JSON if it is new).

    The new one is written beside the old one, which is moved aside, not deleted, before the new one takes
    its place; if that ends halfway, the next call (or ``recover``) puts back what was moved aside.  Readers that need one
    whole version at any time use ``publish``.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    recover(spark, base)
    fs, old, new, aside = _path(spark, path), *(_hadoop(spark, f"{base}{x}") for x in ("", ".new", ".old"))
    there = fs.exists(old)
    parquet = there and any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(old))
    df.write.mode("overwrite").format("parquet" if parquet else "json").save(f"{base}.new")
    if there and not fs.rename(old, aside):
        raise OSError(f"{path} couldn't be moved aside")
    if not fs.rename(new, old):
        recover(spark, base)
        raise OSError(f"{path} couldn't be replaced")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> bool:
    """After a ``replace`` that ended halfway: the table that was moved aside goes back, or goes if the new one is in place."""
    base = path.rstrip("/")
    fs, old, aside = _path(spark, path), _hadoop(spark, base), _hadoop(spark, f"{base}.old")
    if not fs.exists(aside):
        return False
    return fs.delete(aside, True) if fs.exists(old) else fs.rename(aside, old)


def publish(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A table written anew as a version of its own, which a pointer then names.

    ``path`` has a folder for each version and a file CURRENT with the name of one; the file is written beside the
    old one and moved over it in one step, so a reader sees one whole version before, during and after.  The
    version before stays until the next one, for readers that have begun; older ones go.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    fs, before = _path(spark, path), current_version(spark, path)
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.format(form).save(f"{base}/{name}")
    pointer = _hadoop(spark, f"{base}/CURRENT-{name}")
    stream = fs.create(pointer, True)
    stream.write(f"{name} {form}".encode())
    stream.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(pointer, _hadoop(spark, f"{base}/CURRENT"), options)
    keep = {name, before[0] if before else name}
    for status in fs.listStatus(_hadoop(spark, base)):
        if (child := status.getPath().getName()).startswith("v-") and child not in keep:
            fs.delete(status.getPath(), True)


def current_version(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """Name and format of the version that a published table has now; None if it has none."""
    fs, pointer = _path(spark, path), _hadoop(spark, f"{path.rstrip('/')}/CURRENT")
    if not fs.exists(pointer):
        return None
    name, form = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(pointer), "UTF-8").split()
    return name, form


def published(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """What ``publish`` wrote last."""
    found = current_version(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    reader = spark.read.format(found[1])
    return (reader.schema(schema) if schema else reader).load(f"{path.rstrip('/')}/{found[0]}")


def backup(spark: SparkSession, path: str, target: str) -> None:
    """A copy of a file or folder; refuses to write over one that is there."""
    fs = _path(spark, path)
    if _path(spark, target).exists(_hadoop(spark, target)):
        raise FileExistsError(target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, _hadoop(spark, path), _path(spark, target), _hadoop(spark, target), False, spark.sparkContext._jsc.hadoopConfiguration())


def write_log(df: DataFrame, path: str) -> None:
    """A job's records: one text column as lines, other frames as JSON."""
    (df.write.mode("overwrite").text if [t for _, t in df.dtypes] == ["string"] else df.write.mode("overwrite").json)(path)


def coloured_rows(cells: DataFrame, plain: list[str], only: str | None = None) -> DataFrame:
    """(sheet, row_no, cells) of rows with a coloured cell: filled other than ``plain``, or just ``only``; cells in column order."""
    fill = F.upper("fill_rgb")
    wanted = fill.isNotNull() & (fill == only.upper() if only else ~fill.isin(*[p.upper() for p in plain]))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col_no", "value"))), lambda x: F.coalesce(x["value"], F.lit("")))
    return cells.where(wanted).groupBy("sheet", "row_no").agg(F.array_join(ordered, " | ").alias("cells"))


def _hadoop(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _path(spark: SparkSession, path: str):
    return _hadoop(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
