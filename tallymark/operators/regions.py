"""Region dimension joins and source attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallymark.functions.text import relabel
from tallymark.operators.ordered import first_match

# Province names and the abbreviations used as series keys.
PROVINCE_CODES = {
    "British Columbia": "bc",
    "Alberta": "ab",
    "Saskatchewan": "sk",
    "Manitoba": "mb",
    "Ontario": "on",
    "Quebec": "qc",
    "New Brunswick": "nb",
    "Nova Scotia": "ns",
    "Prince Edward Island": "pe",
    "Newfoundland and Labrador": "nl",
}


def to_authorities(
    df: DataFrame, region_map: DataFrame, location: str = "location", whole: str = "Saskatchewan",
    unknown: str = "Unknown",
) -> DataFrame:
    """Add ``authority`` to every location; unlisted ones get ``unknown``, total rows ``whole``.

    A location listed under two authorities belongs to the first one, so rows never multiply.
    """
    dim = first_match(region_map, "location", "authority", "position")
    joined = df.join(dim.withColumnRenamed("location", location), location, "left")
    return joined.withColumn(
        "authority",
        F.when(F.col("authority").isNotNull(), F.col("authority"))
        .when(F.lower(location) == "total", F.lit(whole))
        .otherwise(F.lit(unknown)),
    )


def totals_by_authority(
    df: DataFrame, region_map: DataFrame, value: str, keys: Sequence[str], location: str = "location", **names: str
) -> DataFrame:
    """Sum per authority. Locations are summed first, so the join sees one row per location and key."""
    reduced = df.groupBy(location, *keys).agg(F.sum(value).alias(value))
    placed = to_authorities(reduced, region_map, location, **names)
    return placed.groupBy("authority", *keys).agg(F.sum(value).alias(value))


def add_province_code(df: DataFrame, column: str = "geo") -> DataFrame:
    return df.withColumn("code", relabel(F.col(column), PROVINCE_CODES))


def match_features(series: DataFrame, features: DataFrame, geo: str = "geo") -> DataFrame:
    """Series rows whose region has a map feature of the same name."""
    return series.join(features.withColumnRenamed("ENGNAME", geo), geo)


def without_match(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with no partner on the other side (regions without a feature, sources not landed)."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def attach_source(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add the scrape and data-until dates of each row's source."""
    return df.join(catalogue.select("source", "as_of", "data_until"), "source", "left")


def source_list(df: DataFrame) -> DataFrame:
    """Each named source once, with the dates of its newest version."""
    return df.groupBy("name").agg(F.max("as_of").alias("as_of"), F.max("data_until").alias("data_until"))
