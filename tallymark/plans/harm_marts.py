"""Marts over published harm tables: counts, rates and percentages in one long shape.

Long shape: ``(geo, year, series, metric, value)`` with metrics ``counts``, ``rates``, ``percentages``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions import numbers as N, periods as P
from tallymark.functions.text import DRUG_LABELS, clean_label, no_nbsp, relabel
from tallymark.operators import measures as M, regions as G, reshape as R, select as S
from tallymark.operators.presentation import series_rows
from tallymark.plans.settle import settled

METRICS = ["percentages", "counts", "rates"]


def typed_indicators(raw: DataFrame) -> DataFrame:
    """The national indicator table with typed period and value; the printed text is kept."""
    return raw.select(
        F.col("Region").alias("geo"), F.col("Source").alias("event"), F.col("Substance").alias("substance"),
        F.col("Specific_Measure").alias("measure"), F.col("Disaggregator").alias("series"),
        F.col("Time_Period").alias("period_type"), F.col("Unit").alias("unit"),
        F.trim(no_nbsp(F.col("Year_Quarter"))).alias("label"),
        P.period_year(F.col("Year_Quarter")).alias("year"),
        P.is_partial(F.col("Year_Quarter")).alias("is_partial"),
        clean_label(F.col("Value")).alias("raw_value"),
        N.to_number(F.col("Value")).alias("value"),
        N.is_suppressed(F.col("Value")).alias("is_suppressed"),
    )


def yearly(ind: DataFrame, event: str = "Deaths", **dims) -> DataFrame:
    return S.slice_indicator(ind, event=event, period_type="By year", **dims)


def overall_totals(ind: DataFrame) -> DataFrame:
    """Total events per region, year and substance."""
    return yearly(ind, measure="Overall numbers", unit="Number").select(
        "geo", "year", "substance", F.col("value").alias("total")
    )


def composition(
    ind: DataFrame, measures: Mapping[str, str], population: DataFrame | None = None,
    total_substance: str | None = None, truncate: bool = False, population_mode: str = "same_year",
    align: bool = False,
) -> DataFrame:
    """Published percentages per series, the counts behind them and, with a population, their rates.

    ``measures`` names the measure to read per substance. Measures without any non-zero value are
    left out. Counts use the substance's own total unless ``total_substance`` names another one.
    ``align`` gives all series the same years, filled with 0.
    """
    wanted = [F.struct(F.lit(s), F.lit(m)) for s, m in measures.items()]
    percents = yearly(ind, unit="Percent").filter(F.struct("substance", "measure").isin(*wanted)).select(
        "geo", "substance", "series", "year", F.coalesce("value", F.lit(0.0)).alias("percent")
    )
    live = M.drop_empty_measures(percents, ["geo", "substance"], "percent")
    if align:
        live = settled(live)
        axis = R.shared_axis(live, "year")
        live = R.fill_periods(live, ["geo", "substance", "series"], "year", ["percent"], axis)
    totals = overall_totals(ind)
    on = ["geo", "year", "substance"]
    if total_substance is not None:
        totals = totals.filter(F.col("substance") == total_substance).drop("substance")
        on = ["geo", "year"]
    counted = M.add_count_from_percent(live, totals, on, truncate=truncate)
    if population is not None:
        counted = M.add_rate(counted, population, "count", population_mode)
    return _long(counted, ["geo", "substance", "series", "year"])


def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    named = {"percent": "percentages", "count": "counts", "rate": "rates"}
    present = {c: m for c, m in named.items() if c in df.columns}
    return (
        df.select(*keys, *[F.col(c).cast("double").alias(m) for c, m in present.items()])
        .unpivot(keys, list(present.values()), "metric", "value")
    )


def deaths_by_age(ind: DataFrame, substance: str = "Opioids") -> DataFrame:
    return composition(ind, {substance: "Age group"})


def deaths_by_drug_type(ind: DataFrame, population: DataFrame, population_mode: str = "same_year") -> DataFrame:
    measures = {"Opioids": "Type of opioids", "Stimulants": "Type of stimulants"}
    return composition(ind, measures, population, population_mode=population_mode)


def deaths_by_sex(ind: DataFrame, **options) -> DataFrame:
    """Shares and counts by sex, with the crude rates as published."""
    shares = settled(composition(ind, {"Opioids": "Sex", "Stimulants": "Sex"}, align=True, **options))
    crude = yearly(ind, measure="Sex", unit="Crude rate").select(
        "geo", "substance", "series", "year", F.lit("rates").alias("metric"), "value"
    )
    live = shares.select("geo", "substance").distinct()
    return R.stack_rows(shares, crude.join(live, ["geo", "substance"], "left_semi"))


def deaths_by_manner(ind: DataFrame, population: DataFrame, **options) -> DataFrame:
    return composition(ind, {"Opioids": "Manner of death", "Stimulants": "Manner of death"}, population, align=True, **options)


def national_deaths(
    ind: DataFrame, population: DataFrame, mode: str = "same_year", substance: str = "Opioids"
) -> DataFrame:
    """Deaths and death rates per province and year, partial years and suppressed values flagged."""
    rows = yearly(ind, measure="Overall numbers", unit="Number", substance=substance, geo=list(G.PROVINCE_CODES))
    rated = M.add_rate(rows, population, "value", mode)
    return G.add_province_code(rated).select(
        "geo", "code", "year", "label", "is_partial", "raw_value", "is_suppressed",
        F.col("value").alias("count"), "rate",
    )


def year_table(wide: DataFrame, label: str, metric: str, geo: Column | None = None) -> DataFrame:
    """A printed table (label column, then one column per year) to the long shape."""
    long = R.wide_to_long(wide, [label], "_year", "raw_value")
    name = clean_label(F.col(f"`{label}`"))
    return long.select(
        (name if geo is None else geo).alias("geo"),
        P.period_year(F.col("_year")).alias("year"),
        name.alias("series"),
        F.lit(metric).alias("metric"),
        clean_label(F.col("raw_value")).alias("raw_value"),
        N.to_number(F.col("raw_value")).alias("value"),
    )


def regional_heatmap(counts: DataFrame, rates: DataFrame, count_label: str, rate_label: str) -> DataFrame:
    """Deaths and death rates per health authority and year."""
    return R.stack_rows(year_table(counts, count_label, "counts"), year_table(rates, rate_label, "rates"))


def sex_by_authority(tables: DataFrame, whole: str = "British Columbia") -> DataFrame:
    """Long tables titled ``<authority>: <measure>`` to rows per authority; the provincial one is left out.

    ``tables`` holds ``title, label, year, raw_value``.
    """
    authority = F.trim(F.replace(F.split_part("title", F.lit(":"), F.lit(1)), F.lit(" Health Authority"), F.lit("")))
    measure = F.trim(F.split_part("title", F.lit(":"), F.lit(2)))
    return tables.select(
        authority.alias("geo"), "year", F.lower("label").alias("series"),
        F.when(F.lower(measure).contains("rates"), "rates").otherwise("counts").alias("metric"),
        N.to_number(F.col("raw_value")).alias("value"),
    ).filter(F.col("geo") != whole)


def deaths_per_drug(percents: DataFrame, totals: DataFrame, population: DataFrame, label: str, geo: str) -> DataFrame:
    """Year table of percentages with counts (from yearly totals) and rates. ``totals``: geo, year, total."""
    long = year_table(percents, label, "percentages", F.lit(geo)).select(
        "geo", "series", "year", F.col("value").alias("percent")
    )
    counted = M.add_count_from_percent(long, totals, ["geo", "year"])
    return _long(M.add_rate(counted, population, "count"), ["geo", "series", "year"])


def deaths_by_age_tables(counts: DataFrame, rates: DataFrame, label: str, geo: str) -> DataFrame:
    """Age tables; the printed total becomes a row type of its own, blanks stay unknown."""
    both = R.stack_rows(year_table(counts, label, "counts", F.lit(geo)), year_table(rates, label, "rates", F.lit(geo)))
    return both.withColumns({
        "is_total": F.col("series").contains("Total"),
        "series": F.when(F.col("series") == "Not available", "Age Unavailable").otherwise(F.col("series")),
    })


def confirmed_totals(manner_rows: DataFrame) -> DataFrame:
    """Confirmed deaths per year from the report's manner rows (``manner, year, raw_value``, and ``geo`` if they have it)."""
    rows = S.without_labels(manner_rows, "manner", ["Total", "Suspected"])
    return rows.groupBy(*[c for c in ("geo", "year") if c in rows.columns]).agg(F.sum(F.coalesce(N.dashes_as_zero(F.col("raw_value")), F.lit(0.0))).cast("bigint").alias("total"))


def deaths_by_place(place_rows: DataFrame, region_map: DataFrame) -> DataFrame:
    """Deaths per health authority and year from the report's location rows."""
    typed = place_rows.select(
        "location", "year", F.coalesce(N.dashes_as_zero(F.col("raw_value")), F.lit(0.0)).cast("bigint").alias("count")
    )
    return G.totals_by_authority(typed, region_map, "count", ["year"])


def deaths_by_opioid_type(drug_rows: DataFrame, totals: DataFrame, population: DataFrame, geo: str | None = None) -> DataFrame:
    """Deaths per drug and year: count, percent of the year's confirmed deaths, rate.

    ``drug_rows``: ``year, drug, raw_value`` (manners are summed up); ``totals``: ``year, total``. Without a ``geo`` for
    all rows both hold a column ``geo``, and each region has totals of its own."""
    if geo is not None:
        drug_rows, totals = drug_rows.withColumn("geo", F.lit(geo)), totals.withColumn("geo", F.lit(geo))
    counts = drug_rows.groupBy("geo", "year", "drug").agg(
        F.sum(F.coalesce(N.dashes_as_zero(F.col("raw_value")), F.lit(0.0))).cast("bigint").alias("count")
    )
    shared = counts.join(totals, ["geo", "year"], "left").select(
        "geo", "year", relabel(F.col("drug"), DRUG_LABELS).alias("series"), "count",
        N.percent_or_zero(F.col("count"), F.col("total")).alias("percent"),
    )
    return _long(M.add_rate(shared, population, "count"), ["geo", "series", "year"])


def unit_year_totals(monthly: DataFrame, whole: str = "All") -> DataFrame:
    """Monthly values per health unit (``unit, year, month, raw_value``) to yearly totals; the printed
    provincial total is kept apart from the units."""
    totals = M.year_totals(monthly, ["unit", "year"], "raw_value")
    return totals.withColumn("geo_type", F.when(F.col("unit") == whole, "province").otherwise("health_unit"))


def provincial_drug_totals(monthly: DataFrame) -> DataFrame:
    """Monthly drug series (``series, year, month, raw_value, as_of``) to yearly totals, all series
    together as ``all drugs``, each with the date it is complete until."""
    totals = settled(M.year_totals(monthly, ["series", "year"], "raw_value").select("series", "year", "value"))
    every = totals.groupBy("year").agg(F.sum("value").alias("value")).select(F.lit("all drugs").alias("series"), "year", "value")
    started = monthly.withColumn("_start", F.make_date("year", "month", F.lit(1)))
    until = settled(M.complete_until(started, ["series"], "raw_value", "_start", F.col("as_of")))
    overall = until.agg(F.min("complete_until").alias("complete_until")).select(
        F.lit("all drugs").alias("series"), "complete_until"
    )
    return R.stack_rows(totals, every).join(R.stack_rows(until, overall), "series")


def chart_rows(mart: DataFrame, chart: str, series: Column | str = "series") -> DataFrame:
    """Mart rows to series rows; values that are not published become 0, as charts need a number."""
    named = mart.select(
        F.lit(chart).alias("chart"), "geo", "metric", (F.col(series) if isinstance(series, str) else series).alias("series"),
        "year", F.coalesce("value", F.lit(0.0)).alias("value"),
    )
    return series_rows(named, ["chart", "geo", "metric", "series"], "year", "value")


def province_bundle(charts: Mapping[str, DataFrame]) -> DataFrame:
    """Series rows of several charts together; one document per chart and province at the sink."""
    return R.stack_rows(*[chart_rows(mart, chart) for chart, mart in charts.items()])
