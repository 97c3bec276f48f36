"""Incremental loads and freshness checks; every load can be repeated without changing the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

COPIES_PER_ROW = 10_000


def new_rows(
    feed: DataFrame, stored: DataFrame, date: str | None = None, version: str | None = None
) -> DataFrame:
    """Rows of a re-read feed that are not stored yet, copies included.

    A feed that repeats the newest stored rows adds only what lies beyond them. Copies are counted,
    not numbered: each side is reduced to one row per distinct record (map-side first), so a record
    with very many copies is never ranked inside one task. With ``date``, the stored side is read
    only from the feed's first date on, and where it has no date. A feed holding several landings names its ``version`` column:
    a record then counts as often as in the landing that has most copies of it.
    """
    columns = [c for c in feed.columns if c != version]
    if date is not None:
        first = feed.agg(F.min(date)).scalar()
        stored = stored.filter(F.col(date).isNull() | (F.col(date) >= first))
    if version is None:
        landed = feed.select(*columns, F.lit(1).cast("bigint").alias("_n"))
    else:
        per_version = feed.groupBy(version, *columns).agg(F.count("*").alias("_n"))
        landed = per_version.groupBy(*columns).agg(F.max("_n").alias("_n"))
    known = stored.select(*columns, F.lit(-1).cast("bigint").alias("_n"))
    surplus = landed.unionAll(known).groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n > 0")
    return repeat_rows(surplus, "_n")


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` over. Runs are cut into pieces and dealt out before they are expanded, so no
    task writes all copies of one record."""
    kept = [c for c in df.columns if c != times]
    last = F.floor((F.col(times) - 1) / COPIES_PER_ROW)
    pieces = df.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition("_piece", *kept)
    size = F.least(F.lit(COPIES_PER_ROW), F.col(times) - F.col("_piece") * COPIES_PER_ROW).cast("int")
    return pieces.withColumn("_copy", F.explode(F.sequence(F.lit(1), size))).select(*kept)


def replace_from_year(stored: DataFrame, feed: DataFrame, year: str) -> DataFrame:
    """Stored years before the feed's first year, and the feed from there on.

    A feed without years leaves all stored years. Stored rows without a year stay unless the feed has
    such rows of its own, which then replace them."""
    first = feed.agg(F.min(year)).scalar()
    undated = feed.agg(F.max(F.col(year).isNull())).scalar()
    kept = F.when(F.col(year).isNull(), ~F.coalesce(undated, F.lit(False))).otherwise(first.isNull() | (F.col(year) < first))
    return stored.filter(kept).unionByName(feed.select(*stored.columns))


def newer_sources(landed: DataFrame, stored: DataFrame, end: str | None = None) -> DataFrame:
    """Landed sources that are not stored yet or have a later scrape date than the stored version.

    With ``end``, the column of the data's own last day, a later scrape of data that ends where the
    stored data ends is not newer."""
    known = stored.select(F.col("source").alias("_source"), F.col("as_of").alias("_stored"), (F.col(end) if end else F.lit(None)).alias("_end"))
    newer = F.col("as_of") > F.col("_stored")
    if end:
        newer = newer & ~F.col(end).eqNullSafe(F.col("_end"))
    both = landed.join(known, F.col("source") == F.col("_source"), "left")
    return both.filter(F.col("_source").isNull() | F.col("_stored").isNull() | newer).drop("_source", "_stored", "_end")


def shape_drift(counted: DataFrame, expected: DataFrame, on: Sequence[str] = ("source",)) -> DataFrame:
    """Sources whose counted pages, tabs or columns differ from what is expected."""
    return (
        counted.join(expected, list(on), "full_outer")
        .filter(~F.col("counted").eqNullSafe(F.col("expected")))
        .select(*on, "counted", "expected")
    )
