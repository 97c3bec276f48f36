"""XLSX workbooks as a tall cell table, and the header rules on top of it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.schemas import WORKBOOK_CELLS

BATCH_CELLS = 20_000


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every filled cell of every sheet: ``(path, sheet, row_no, col_no, value)``, numbered from 0."""
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    return books.mapInPandas(_cells, WORKBOOK_CELLS)


def sheet_titles(cells: DataFrame) -> DataFrame:
    """Title of a sheet: the first header that is not a placeholder."""
    real = ~F.col("value").contains("Unnamed") & (F.col("value") != "NaN")
    return (
        cells.filter((F.col("row_no") == 0) & real)
        .groupBy("path", "sheet").agg(F.min_by("value", "col_no").alias("title"))
    )


def promote_header(cells: DataFrame, header_row: int = 0) -> DataFrame:
    """Cells below the header row, each with its column's header; row numbers restart at 0."""
    keys = ["path", "sheet", "col_no"]
    header = cells.filter(F.col("row_no") == header_row).select(*keys, F.col("value").alias("header"))
    return (
        cells.filter(F.col("row_no") > header_row).join(header, keys)
        .withColumn("row_no", F.col("row_no") - (header_row + 1))
    )


def drop_columns(cells: DataFrame, *col_nos: int) -> DataFrame:
    return cells.filter(~F.col("col_no").isin(*col_nos))


def complete_rows(cells: DataFrame) -> DataFrame:
    """Rows in which no column of the sheet is empty (empty rows hold no cells at all)."""
    width = cells.groupBy("path", "sheet").agg(F.countDistinct("col_no").alias("_width"))
    filled = cells.groupBy("path", "sheet", "row_no").agg(F.count("value").alias("_filled"))
    full = filled.join(width, ["path", "sheet"]).filter("_filled = _width")
    return cells.join(full, ["path", "sheet", "row_no"], "left_semi")


def cells_to_table(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells with headers to a table of the named columns, one row per sheet row."""
    return (
        cells.groupBy("path", "sheet", "row_no").pivot("header", list(columns)).agg(F.first("value"))
    )


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                shared = _shared_strings(zf)
                for sheet, part in _sheets(zf):
                    yield from _sheet_cells(zf, path, sheet, part, shared)


def _tag(element) -> str:
    # strict and transitional workbooks differ only in the namespace
    return element.tag.rsplit("}", 1)[-1]


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    with zf.open("xl/sharedStrings.xml") as part:
        return [_texts(e) for _, e in ElementTree.iterparse(part) if _tag(e) == "si"]


def _sheets(zf: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    links = {
        e.get("Id"): e.get("Target")
        for e in ElementTree.fromstring(zf.read("xl/_rels/workbook.xml.rels")).iter()
        if _tag(e) == "Relationship"
    }
    for e in ElementTree.fromstring(zf.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet":
            link = next(v for k, v in e.attrib.items() if k.endswith("}id"))
            target = links[link]
            yield e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _position(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for letter in letters:
        col = col * 26 + ord(letter) - 64
    return int(digits) - 1, col - 1


def _cell_value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _texts(cell)
    text = next((v.text for v in cell if _tag(v) == "v"), None)
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)]
    return text[:-2] if kind in (None, "n") and text.endswith(".0") else text


def _sheet_cells(zf, path: str, sheet: str, part: str, shared: list[str]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    with zf.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if _tag(row) != "row":
                continue
            for cell in row:
                value = _cell_value(cell, shared)
                if value not in (None, ""):
                    rows.append((path, sheet, *_position(cell.get("r")), value))
            row.clear()
            if len(rows) >= BATCH_CELLS:
                yield _frame(rows)
                rows = []
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "sheet", "row_no", "col_no", "value"])
