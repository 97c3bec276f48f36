"""The landing zone: what the file names say about each landed source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.functions.periods import stamp_to_date
from tallymark.operators.ordered import newest_row

# <scrape date>[_<data until>]_<source>[_<number>].<extension>
NAME_PATTERN = r"^(\d{8})(?:_(\d{8}|\d{6}))?_([A-Za-z][A-Za-z0-9]*)(?:_(\d+))?\.([A-Za-z]+)$"


def name_fields(name: Column) -> dict[str, Column]:
    """Source key, dates and format of a landed file. Without an end date, the scrape date stands in."""
    as_of = stamp_to_date(F.regexp_extract(name, NAME_PATTERN, 1))
    until = stamp_to_date(F.regexp_extract(name, NAME_PATTERN, 2))
    return {
        "source": F.nullif(F.regexp_extract(name, NAME_PATTERN, 3), F.lit("")),
        "as_of": as_of,
        "data_until": F.coalesce(until, as_of),
        "format": F.lower(F.nullif(F.regexp_extract(name, NAME_PATTERN, 5), F.lit(""))),
    }


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per landed file. Only file status is read, not content; foreign files are left out."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )
    return files.withColumns(name_fields(F.col("file_name"))).filter("source is not null and as_of is not null")


def latest_files(files: DataFrame) -> DataFrame:
    """The newest file of every source."""
    return newest_row(files, ["source"], ["as_of", "data_until", "path"])


def missing_sources(files: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("source").distinct().join(files, "source", "left_anti")


def existing_sources(files: DataFrame, wanted: DataFrame) -> DataFrame:
    return files.join(wanted.select("source").distinct(), "source", "left_semi")


def latest_path(files: DataFrame, source: str) -> str:
    """Path of the newest file of one source; fails when the source has not landed."""
    row = latest_files(files.filter(F.col("source") == source)).select("path").first()
    if row is None:
        raise FileNotFoundError(f"source {source!r} has not landed")
    return row["path"]
