"""Chart-side aggregates over marts: totals, shares, stacks, axes, display text and series documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymark.functions import numbers as N
from tallymark.operators.measures import share_of_total
from tallymark.operators.ordered import running_total


def _first_nonzero(series: Sequence[str], period: str, value: str) -> Column:
    """First period in which the series is not zero.

    The window holds one series of a mart: at most one row per period of the axis.
    """
    return F.min(F.when(F.col(value) != 0, F.col(period))).over(Window.partitionBy(*series))


def trim_leading_zeros(df: DataFrame, series: Sequence[str], period: str, value: str) -> DataFrame:
    """Start every series at its first non-zero period; all-zero series vanish."""
    return (
        df.withColumn("_first", _first_nonzero(series, period, value))
        .filter(F.col(period) >= F.col("_first"))
        .drop("_first")
    )


def leading_zeros_as_text(
    df: DataFrame, series: Sequence[str], period: str, value: str, name: str = "shown"
) -> DataFrame:
    """Table text of a value: zeros before the first non-zero period read "No Data"."""
    before = F.coalesce(F.col(period) < _first_nonzero(series, period, value), F.lit(False))
    return df.withColumn(name, F.when(before, F.lit("No Data")).otherwise(F.col(value).cast("string")))


def first_period_with_data(df: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Initial slider position of each chart."""
    return df.filter(F.col(value) != 0).groupBy(*by).agg(F.min(period).alias("first_period"))


def national_total(df: DataFrame, period: str, raw: str) -> DataFrame:
    """Total over all regions per period; text that is no number counts as 0."""
    return df.groupBy(period).agg(F.sum(N.to_number_or_zero(F.col(raw))).alias("total"))


def selected_total(df: DataFrame, selected: Sequence[str], geo: str, period: str, value: str) -> DataFrame:
    return df.filter(F.col(geo).isin(*selected)).groupBy(period).agg(F.sum(value).alias("total"))


def selected_peak(df: DataFrame, selected: Sequence[str], geo: str, period: str, value: str) -> DataFrame:
    """Highest total of the selected regions and the axis end it asks for."""
    totals = selected_total(df, selected, geo, period, value)
    peak = totals.agg(F.max("total").alias("peak"))
    return peak.withColumn("axis_end", N.axis_ceiling(F.col("peak")))


def percent_stack(
    df: DataFrame, selected: Sequence[str], geo: str, period: str, value: str
) -> DataFrame:
    """Share of every selected region in the selected total of its period."""
    return share_of_total(df.filter(F.col(geo).isin(*selected)), [period], value)


def stack_heights(df: DataFrame, period: str, series_no: str, value: str) -> DataFrame:
    """Upper edge of every series when the series of a period are stacked in ``series_no`` order."""
    return running_total(df, [period], series_no, {"stacked": F.col(value)})


def drop_zero_slices(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value) != 0)


def empty_periods(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Groups (region and year, say) in which every slice is zero."""
    return df.groupBy(*by).agg(F.bool_or(F.col(value) != 0).alias("_any")).filter(~F.col("_any")).drop("_any")


def series_rows(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Parallel ``x``/``y`` arrays per series. A series has one value per period, so the arrays are
    as long as the axis."""
    points = F.sort_array(F.collect_list(F.struct(F.col(period), F.col(value))))
    return (
        df.groupBy(*keys).agg(points.alias("_points"))
        .select(
            *keys,
            F.transform("_points", lambda p: p[period].cast("string")).alias("x"),
            F.transform("_points", lambda p: p[value].cast("double")).alias("y"),
        )
    )


def series_lines(rows: DataFrame) -> DataFrame:
    """One JSON line per series, for charts with any number of series (token charts)."""
    return rows.select(F.col("chart"), F.col("geo"), F.to_json(F.struct(*rows.columns)).alias("value"))


def series_documents(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One JSON document per chart and region: ``{data: {metric: {series: {x, y}}}, data_source}``.

    For charts whose series come from a dimension (regions, drug types, age groups). Charts over an
    open vocabulary are published with :func:`series_lines`.
    """
    # an entry of the outer list is one metric, of the inner list one series of that metric
    metric = rows.groupBy("chart", "geo", "metric").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("series", F.struct("x", "y"))))).alias("lines")
    )
    by_name = lambda a, b: F.when(a["metric"] < b["metric"], -1).when(a["metric"] > b["metric"], 1).otherwise(0)
    charts = metric.groupBy("chart", "geo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "lines")), by_name)).alias("data")
    )
    if sources is None:
        return charts.select("chart", "geo", F.to_json(F.struct("data")).alias("value"))
    source = F.struct(*[c for c in sources.columns if c != "chart"]).alias("data_source")
    return charts.join(sources, "chart", "left").select(
        "chart", "geo", F.to_json(F.struct("data", source)).alias("value")
    )
