"""Grids inside web pages as cell rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions.text import clean_label
from tallymark.operators.ordered import cycle_header_years, month_header_years
from tallymark.schemas import GRID_CELLS

# Elements and ARIA roles that open a grid, a row and a cell.
GRID_PARTS = {"table": "grid", "ul": "grid", "ol": "grid", "grid": "grid", "tr": "row", "li": "row", "row": "row"}
CELL_PARTS = {
    "td": "gridcell", "th": "columnheader", "a": "gridcell",
    "gridcell": "gridcell", "columnheader": "columnheader", "rowheader": "rowheader",
}
BATCH_CELLS = 20_000


def read_grid_cells(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Cells of all grids of a page: ARIA grids (``role=row/columnheader/rowheader/gridcell``),
    tables (``tr/th/td``) and link lists (``li/a``). Numbers start at 0."""
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html"))
    # pages without any opening of a grid never reach Python
    source = source.filter(F.col("html").rlike(r"(?i)<(?:table|ul|ol)\b|\brole\b"))
    return source.mapInPandas(_cells, GRID_CELLS)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple] = []
        for page_id, html in zip(batch["page_id"], batch["html"]):
            if html is None:
                continue
            reader = _GridReader()
            reader.feed(html)
            reader.close()
            out.extend((page_id, *cell) for cell in reader.cells)
            if len(out) >= BATCH_CELLS:
                yield _frame(out)
                out = []
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "grid_no", "row_no", "cell_no", "role", "text"])


class _GridReader(HTMLParser):
    """Collects ``(grid, row, cell, role, text)``; nested grids get numbers of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple] = []
        self.grids = 0
        self.at = [-1, -1, 0]  # current grid, row and next cell
        self.open: list[tuple[str, str, list[int]]] = []  # tag, part, position outside of it
        self.cell: tuple[str, list[str]] | None = None  # role and text pieces

    def handle_starttag(self, tag, attrs):
        role = dict(attrs).get("role") or tag
        part = GRID_PARTS.get(role) or ("cell" if role in CELL_PARTS else "")
        if part == "grid" and self.cell is None:
            self.open.append((tag, part, self.at))
            self.at = [self.grids, -1, 0]
            self.grids += 1
        elif part == "row" and self.cell is None and self._inside("grid"):
            self.open.append((tag, part, []))
            self.at = [self.at[0], self.at[1] + 1, 0]
        elif part == "cell" and self.cell is None and self._inside("row"):
            self.open.append((tag, part, []))
            self.cell = (CELL_PARTS[role], [])
        elif any(t == tag for t, _, _ in self.open):
            # an element of the same name inside a part: its end must not close the part
            self.open.append((tag, "", []))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[1].append(data)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.open):
            return
        closed = None
        while closed != tag:
            closed, part, outside = self.open.pop()
            if part == "cell":
                role, pieces = self.cell
                self.cells.append((*self.at, role, "".join(pieces)))
                self.at = [*self.at[:2], self.at[2] + 1]
                self.cell = None
            elif part == "grid":
                self.at = outside

    def _inside(self, part: str) -> bool:
        return any(p == part for _, p, _ in self.open)


def grid_headers(cells: DataFrame) -> DataFrame:
    """Column headers of every grid, numbered from the left."""
    return cells.filter("role = 'columnheader'").select(
        "page_id", "grid_no", "row_no", F.col("cell_no").alias("col_no"), clean_label(F.col("text")).alias("header")
    )


def grid_records(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Data rows of fixed-layout tables: the cells of a row become the named columns by position."""
    rows = cells.filter("role in ('gridcell', 'rowheader')").groupBy("page_id", "grid_no", "row_no")
    return rows.agg(*[F.max(F.when(F.col("cell_no") == i, F.col("text"))).alias(c) for i, c in enumerate(columns)])


def grid_long(cells: DataFrame, title: Column, base_year: int, header: str = "plain") -> DataFrame:
    """Grids to ``(title, row label, column, year, value)``.

    ``header`` says how the years of the columns are found: ``plain`` (a single header row),
    ``monthly`` or ``yearly`` (a second header row whose labels repeat from year to year).
    """
    keys = ["page_id", "grid_no"]
    header_row = 0 if header == "plain" else 1
    heads = grid_headers(cells).filter(F.col("row_no") == header_row).drop("row_no")
    labelled = heads.filter("col_no > 0")
    if header == "monthly":
        dated = month_header_years(labelled, keys, base_year)
    elif header == "yearly":
        dated = cycle_header_years(labelled, keys, base_year)
    else:
        dated = labelled.withColumn("year", F.regexp_extract("header", r"^(\d{4})", 1).try_cast("int"))
    body = cells.filter(F.col("row_no") > header_row)
    labels = body.filter("role = 'rowheader' or cell_no = 0").groupBy(*keys, "row_no").agg(
        F.min_by("text", "cell_no").alias("label")
    )
    values = body.filter("role = 'gridcell' and cell_no > 0").select(
        *keys, "row_no", F.col("cell_no").alias("col_no"), F.col("text").alias("raw_value")
    )
    return (
        values.join(dated, [*keys, "col_no"]).join(labels, [*keys, "row_no"])
        .select(*keys, title.alias("title"), "row_no", "col_no", "label", "header", "year", "raw_value")
    )
