"""Spreadsheets (.xlsx) as cells. A workbook is a zip of XML parts; each is read whole by one task, from any store that Spark reads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table_prep import column_number

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELL = "table_id string, sheet string, ordinal int, row int, col int, kind string, value string"


def _text(node: ElementTree.Element | None) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t")) if node is not None else ""


def _number(text: str) -> str:
    """A stored number as people read it: 2013 and not 2013.0."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """(sheet, ordinal, row, col, value) of every cell that holds something; merged cells hold it at their first place."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for ordinal, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
        target = targets[sheet.get(_REL)].lstrip("/")
        part = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        for c in part.iter(f"{_MAIN}c"):
            letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
            kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                value = _text(c.find(f"{_MAIN}is"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "b":
                value = "TRUE" if v.text == "1" else "FALSE"
            else:
                value = _number(v.text) if kind == "n" else v.text
            yield sheet.get("name"), ordinal, int(digits) - 1, column_number(letters), value


def read_spreadsheet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Cells of workbooks: table_id (file and sheet), sheet, ordinal, row, col, kind, value."""
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f"{name}#{sheet}", sheet, k, r, c, "content", v) for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for sheet, k, r, c, v in workbook_cells(data)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["table_id", "sheet", "ordinal", "row", "col", "kind", "value"])

    return files.mapInArrow(run, CELL)


def fill_grid(cells: DataFrame) -> DataFrame:
    """Cells with blanks for the places of each table's rectangle that hold nothing."""
    size = cells.groupBy("table_id").agg(F.max("row").alias("r"), F.max("col").alias("c"))
    grid = size.select("table_id", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("row"), "c").select("table_id", "row", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("col"))
    return grid.join(cells.select("table_id", "row", "col", "value"), ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.lit("content").alias("kind"), F.coalesce("value", F.lit("")).alias("value"))
