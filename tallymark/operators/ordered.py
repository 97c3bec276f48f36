"""Order-dependent operators: carry-forward, running totals, header years.

A window partitioned by the table key alone would put one table into one task. The scans here cut
every table into blocks of rows, scan inside the blocks, and pass one carry row per block along. A
table that holds a third of all rows is then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tallymark.operators.groups import join_groups

BLOCK_ROWS = 65_536


def _blocked(df: DataFrame, order: str, block_rows: int) -> DataFrame:
    return df.withColumn("_block", F.expr(f"`{order}` div {block_rows}"))


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill NULLs with the last value above them, table by table (merged cells).

    ``order`` is the row number inside the table.
    """
    blocked = _blocked(df, order, block_rows)
    ends = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})
    inside = _inside(keys, F.asc(order))
    return (
        _with_carry_rows(blocked, carried)
        .withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
        .filter("_is_row").select(*df.columns)
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, Column],
    descending: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running sums (``{new column: addend}``) along ``order``, table by table."""
    direction = F.desc if descending else F.asc
    blocked = _blocked(df.withColumns(dict(totals)), order, block_rows)
    sums = blocked.groupBy(*keys, "_block").agg(*[F.sum(n).alias(n) for n in totals])
    before = (
        Window.partitionBy(*keys).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = sums.withColumns({n: F.sum(n).over(before) for n in totals})
    inside = _inside(keys, direction(order))
    return (
        _with_carry_rows(blocked, carried)
        .withColumns({n: F.sum(n).over(inside) for n in totals})
        .filter("_is_row").select(*df.columns, *totals)
    )


def _with_carry_rows(blocked: DataFrame, carried: DataFrame) -> DataFrame:
    """Put one row with the value carried into it in front of every block.

    Rows and carry rows meet in the scan's own shuffle, so no join is needed.
    """
    rows = blocked.withColumn("_is_row", F.lit(True))
    return rows.unionByName(carried.withColumn("_is_row", F.lit(False)), allowMissingColumns=True)


def _inside(keys: Sequence[str], order: Column) -> WindowSpec:
    return (
        Window.partitionBy(*keys, "_block").orderBy("_is_row", order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def month_header_years(
    df: DataFrame, keys: Sequence[str], base_year: int, col_no: str = "col_no", header: str = "header"
) -> DataFrame:
    """Year of every month column, walking from the newest (right) to the oldest column.

    A ``Dec`` met on the way starts the year before.
    """
    back = F.when(F.col(header) == "Dec", 1).otherwise(0)
    out = running_total(df, keys, col_no, {"_back": back}, descending=True)
    return out.withColumn("year", (F.lit(base_year) - F.col("_back")).cast("int")).drop("_back")


def smallest_period(labels: Sequence) -> int:
    """The smallest number of places by which a sequence can be shifted onto itself; its length if there is none.

    ``border[i]`` is the length of the longest proper prefix of the first ``i`` labels that ends them too."""
    border, k = [0] * (len(labels) + 1), 0
    for i in range(1, len(labels)):
        while k and labels[i] != labels[k]:
            k = border[k]
        k += labels[i] == labels[k]
        border[i + 1] = k
    return len(labels) - border[-1]


def steps_back(labels: Sequence) -> list[int]:
    """Years back from the newest one for the labels of a header row, newest first.

    Labels that repeat as a cycle, twice in full at least, step back once a cycle; the oldest may be cut off. In any
    other row each return of the first label steps back."""
    period = smallest_period(labels)
    if 2 * period <= len(labels):
        return [i // period for i in range(len(labels))]
    steps, seen = [], -1
    for label in labels:
        seen += label == labels[0]
        steps.append(seen)
    return steps


def cycle_header_years(
    df: DataFrame, keys: Sequence[str], base_year: int, col_no: str = "col_no", header: str = "header"
) -> DataFrame:
    """Year of every column under a sub-header that repeats once a year, the newest year on the right.

    The cycle is the smallest period of the labels from the right, so a label may occur several times in a year. Where
    none is seen twice, the right-most label closes a year. A header row is one group here, as it is one part of one page."""
    rest = [c for c in df.columns if c not in keys]

    @F.pandas_udf("array<int>")
    def steps(labels: pd.Series) -> pd.Series:
        return labels.map(lambda row: steps_back(list(row)))

    cells = F.array_sort(F.collect_list(F.struct(F.negate(col_no).alias("_from_right"), F.struct(*rest).alias("_cell"))))
    rows = df.groupBy(*keys).agg(cells.alias("_cells"))
    rows = rows.withColumn("_back", steps(F.transform("_cells", lambda c: c["_cell"][header])))
    rows = rows.select(*keys, F.explode(F.arrays_zip("_cells", "_back")).alias("_row"))
    return rows.select(*keys, "_row._cells._cell.*", (F.lit(base_year) - F.col("_row._back")).cast("int").alias("year")).select(*df.columns, "year")


def marker_header_years(
    df: DataFrame, keys: Sequence[str], first_year: int, marker: str,
    col_no: str = "col_no", header: str = "header",
) -> DataFrame:
    """Year of every column where each marker label opens the next year."""
    step = F.when(F.col(header) == marker, 1).otherwise(0)
    out = running_total(df, keys, col_no, {"_step": step})
    return out.withColumn("year", (F.lit(first_year - 1) + F.col("_step")).cast("int")).drop("_step")


def first_match(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key: the one that comes first in ``order`` (as an aggregate, not a ranking)."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def latest_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows of the newest version per key."""
    newest = df.groupBy(*keys).agg(F.max(order).alias(order))
    return join_groups(df, newest, [*keys, order], "left_semi")


def first_rows(df: DataFrame, order: Sequence[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order: a top-k per task, merged; nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def newest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Exactly one row per key, the last by ``order``; map-side combined, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")
