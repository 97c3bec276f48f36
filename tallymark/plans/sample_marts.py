"""Marts over drug-check samples.

All of them start from :func:`typed_samples`; each one reads the samples once and reduces them by a
single ``groupBy``, whatever the number of regions, years and categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.operators import measures as M, reshape as R
from tallymark.plans.settle import settled

FIRST_YEAR = 2018

# The opioids looked for in spectrometer findings.
OPIOIDS = (
    "Codeine", "Fentanyl", "Heroin", "Hydrocodone", "Hydromorphone", "Methadone", "Morphine", "Oxycodone",
    "Buprenorphine",
)


def typed_samples(raw: DataFrame) -> DataFrame:
    date = F.try_to_date("Visit Date", "yyyy-MM-dd")
    return raw.select(
        date.alias("visit_date"),
        F.year(date).alias("year"),
        F.regexp_replace("Health Authority", " Health$", "").alias("geo"),
        F.col("Category").alias("category"),
        F.col("Expected Drug").alias("expected"),
        F.coalesce(F.col("Fentanyl Strip") == "Pos", F.lit(False)).alias("fentanyl_pos"),
        F.coalesce(F.col("Benzo Strip") == "Pos", F.lit(False)).alias("benzo_pos"),
        F.col("Spectrometer").alias("spectrometer"),
        F.split("Spectrometer", ", ").alias("findings"),
    )


def sample_axis(until_year: Column | int) -> Column:
    return R.year_axis(FIRST_YEAR, until_year)


def supply_by_category(samples: DataFrame, axis: Column) -> DataFrame:
    """Samples per year and category, and their share of the year's samples."""
    counts = settled(M.tally(samples, ["year", "category"]))
    filled = R.fill_periods(counts, ["category"], "year", ["n"], axis)
    return M.share_of_total(filled, ["year"], "n")


def strip_positivity(samples: DataFrame) -> DataFrame:
    flags = {"Fentanyl": F.col("fentanyl_pos"), "Benzodiazepines": F.col("benzo_pos")}
    return M.flag_series(M.flagged_counts(samples, ["year"], flags), ["year"], list(flags))


def opioid_types(samples: DataFrame) -> DataFrame:
    """Samples of the class Opioid that mention each opioid, with their share of the class."""
    in_class = samples.filter(F.col("category") == "Opioid")
    return M.keyword_counts(in_class, ["year"], F.col("spectrometer"), OPIOIDS)


def regional_supply(samples: DataFrame) -> DataFrame:
    """Samples per region, year and category, with the total per region and year."""
    placed = samples.filter(F.col("geo").isNotNull())
    return M.grouped_totals(M.tally(placed, ["geo", "year", "category"]), ["geo", "year", "category"], "n")


def regional_findings(samples: DataFrame) -> DataFrame:
    """How often each finding occurs per region, year and category."""
    placed = samples.filter(F.col("geo").isNotNull() & F.col("findings").isNotNull())
    return M.token_counts(placed, ["geo", "year", "category"], "findings")


def supply_series(mart: DataFrame, chart: str, geo: str, name: str) -> DataFrame:
    """Counts and shares of a yearly mart as rows for the chart documents."""
    return mart.select(
        F.lit(chart).alias("chart"), F.lit(geo).alias("geo"), F.col(name).alias("series"), "year",
        F.col("n").cast("double").alias("counts"), F.col("percent").alias("percentages"),
    ).unpivot(["chart", "geo", "series", "year"], ["counts", "percentages"], "metric", "value")


