"""Unions, crosstab <-> long, period axes and zero-filled series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Row union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def wide_to_long(
    df: DataFrame, ids: Sequence[str], name: str, value: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Columns (years, health units, ...) to rows; every value as text, as it was printed."""
    columns = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    text = df.select(
        *[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    )
    return text.unpivot(list(ids), columns, name, value)


def long_to_wide(
    df: DataFrame, row: str, column: str, value: str, columns: Sequence, total: str | None = None
) -> DataFrame:
    """Display table: one row per series, one column per period, optionally a total row.

    The columns are given, so no extra job runs to find them. A row whose value is none of them fails the
    job instead of dropping out of the table; a row without any value has no column and is left out.
    """
    known = F.col(column).isin(*columns) | F.col(column).isNull()
    stray = F.raise_error(F.concat(F.lit(f"{column} without a column: "), F.col(column).cast("string")))
    df = df.withColumn(column, F.when(known, F.col(column)).otherwise(stray))
    if total is not None:
        # the rollup's own NULL is told apart from a NULL label by grouping()
        df = (
            df.rollup(column, row)
            .agg(F.sum(value).alias(value), F.grouping(row).alias("_total"), F.grouping(column).alias("_all"))
            .filter(F.col("_all") == 0)
            .withColumn(row, F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(row)))
            .groupBy(row, "_total")
        )
    else:
        df = df.groupBy(row)
    wide = df.pivot(column, list(columns)).agg(F.sum(value))
    return wide.drop("_total")


def transpose_cells(df: DataFrame) -> DataFrame:
    """Swap rows and columns of a cell table; a pure rename, whatever the size."""
    return df.withColumnsRenamed({"row_no": "_r", "col_no": "row_no"}).withColumnRenamed("_r", "col_no")


def last_column_first(df: DataFrame) -> DataFrame:
    return df.select(df.columns[-1], *df.columns[:-1])


def year_axis(first: Column | int, last: Column | int) -> Column:
    """All years from first to last as an array."""
    first = first if isinstance(first, Column) else F.lit(first)
    last = last if isinstance(last, Column) else F.lit(last)
    return F.sequence(first, last)


def shared_axis(df: DataFrame, period: str) -> Column:
    """Distinct periods over all series, as a scalar subquery (grows with the calendar only)."""
    return df.agg(F.sort_array(F.collect_set(period))).scalar()


def fill_periods(
    df: DataFrame, series: Sequence[str], period: str, values: Sequence[str], axis: Column,
    default: Column | None = None,
) -> DataFrame:
    """Give every series a row for every period of the axis; missing values become ``default`` (0).

    Series are aligned by period, never by position. ``(series, period)`` must be unique: a group
    then holds at most one entry per period, so the map it is gathered into is bounded by the axis.
    """
    default = F.lit(0) if default is None else default
    entry = F.struct(F.col(period), F.struct(*values))
    types = {f.name: f.dataType for f in df.schema.fields}
    return (
        df.groupBy(*series)
        .agg(F.map_from_entries(F.collect_list(entry)).alias("_by_period"))
        .select(*series, F.explode(axis).alias(period), "_by_period")
        .withColumn("_cell", F.try_element_at("_by_period", F.col(period)))
        .select(
            *series, period,
            *[F.coalesce(F.col(f"_cell.{v}"), default.cast(types[v])).alias(v) for v in values],
        )
    )
