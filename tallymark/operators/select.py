"""Slices, title lookups, code lists, drill-downs and saved visuals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions.text import lookup_key, lookup_term
from tallymark.operators.groups import join_groups

# Violation codes of the drug offences.
DRUG_OFFENCE_CODES = (
    "401", "4140", "4120", "410", "4110", "4130", "420", "4240", "4340", "4440",
    "430", "4220", "4320", "440", "4210", "4230", "4310", "4330",
)

# Order in which a chart falls back from one metric to the next.
METRIC_ORDER = ("counts", "rates", "percentages")


def slice_indicator(df: DataFrame, **dims: str | Sequence[str]) -> DataFrame:
    """Keep rows whose dimensions equal the given values; dimensions not named are free.

    Every predicate is a plain comparison with a literal, so all of them reach the scan.
    """
    for name, wanted in dims.items():
        column = F.col(name)
        df = df.filter(column == wanted if isinstance(wanted, str) else column.isin(*wanted))
    return df


def without_labels(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(*labels))


def from_year(df: DataFrame, column: str, year: int) -> DataFrame:
    return df.filter(F.col(column) >= year)


def in_year(date: Column, year: int) -> Column:
    """Year slice as a date range, which a Parquet scan can prune on (year(date) cannot)."""
    return (date >= F.lit(f"{year}-01-01").cast("date")) & (date < F.lit(f"{year + 1}-01-01").cast("date"))


def since_year(date: Column, year: int) -> Column:
    """Lower-bound year as a date, for the same reason."""
    return date >= F.lit(f"{year}-01-01").cast("date")


def has_code(label: Column, codes: Sequence[str] = DRUG_OFFENCE_CODES) -> Column:
    """True where the label carries one of the codes in square brackets."""
    return label.rlike(r"\[(" + "|".join(codes) + r")\]")


def mentions(text: Column, word: str) -> Column:
    """Case-insensitive substring test; analogues containing the word match as well."""
    return F.lower(text).contains(word.lower())


def lookup_titles(df: DataFrame, title: str, terms: Sequence[str], exact: bool = False) -> DataFrame:
    """Rows whose normalised title equals (or contains) one of the normalised terms.

    The terms are call arguments, so the lookup is one filter; no join, no row pairs.
    """
    key = lookup_key(F.col(title))
    wanted = [lookup_term(t) for t in terms]
    if exact:
        return df.filter(key.isin(*wanted))
    return df.filter(reduce(or_, [key.contains(w) for w in wanted], F.lit(False)))


def yearly_tables(df: DataFrame, title: str) -> DataFrame:
    """Of a lookup result, keep the yearly tables and leave out their monthly twins."""
    return df.filter(~F.lower(F.col(title)).contains("month"))


def enabled_only(df: DataFrame, titles: DataFrame, on: str = "title") -> DataFrame:
    """Rows of tables that the title configuration marks as enabled."""
    return df.join(titles.filter("enabled").select(on).distinct(), on, "left_semi")


def trim_rows(df: DataFrame, keys: Sequence[str], row_no: str, head: int, tail: int) -> DataFrame:
    """Drop the first ``head`` and last ``tail`` rows of every table (row numbers start at 0)."""
    last = df.groupBy(*keys).agg(F.max(row_no).alias("_last"))
    return (
        join_groups(df, last, keys)
        .filter((F.col(row_no) >= head) & (F.col(row_no) <= F.col("_last") - tail))
        .drop("_last")
    )


def drill(
    df: DataFrame, geo: str | None = None, year: int | None = None, category: str | None = None
) -> DataFrame:
    """Second-level data of a chart: one region, or one region-year-category cell."""
    for name, wanted in (("geo", geo), ("year", year), ("category", category)):
        if wanted is not None:
            df = df.filter(F.col(name) == F.lit(wanted))
    return df


def preferred_metric(df: DataFrame, keys: Sequence[str], metric: str = "metric") -> DataFrame:
    """Keep, per chart, the first metric of METRIC_ORDER that the chart has."""
    order = F.array_position(F.array(*[F.lit(m) for m in METRIC_ORDER]), F.col(metric))
    ranked = df.withColumn("_order", order).filter(F.col("_order") > 0)
    best = ranked.groupBy(*keys).agg(F.min("_order").alias("_order"))
    return join_groups(ranked, best, [*keys, "_order"], "left_semi").drop("_order")


def match_saved_visuals(
    points: DataFrame, filters: DataFrame, dims: Sequence[str], point_id: str
) -> DataFrame:
    """Points for which every ``(filter_type, filter_value)`` row of a visual holds.

    Visuals are entered in an index under one filter each, the one that the fewest points meet. A point looks up its own
    values, one per dimension, and what it finds there is tested on the other filters. So no point is paired with a
    visual unless it meets that visual's rarest filter, and the fan-out is the number of dimensions in use."""
    ordered = sorted(dims)
    distinct = filters.select("visual_id", "filter_type", "filter_value").distinct()
    wanted = {d: F.max(F.when(F.col("filter_type") == d, F.col("filter_value"))) for d in ordered}
    used = sum((F.when(F.col(f"_{d}").isNotNull(), 1).otherwise(0) for d in ordered), F.lit(0))
    visuals = (
        distinct.groupBy("visual_id").agg(F.count("*").alias("_n"), *[c.alias(f"_{d}") for d, c in wanted.items()])
        # more filters than dimensions in use: two values asked of one dimension, or an unknown one
        .filter(F.col("_n") == used)
    )
    # a missing dimension meets no filter, so it offers nothing
    offers = F.array_compact(F.array(*[
        F.when(F.col(d).isNotNull(), F.struct(F.lit(d).alias("_dim"), F.col(d).cast("string").alias("_value"))) for d in ordered
    ]))
    asked = distinct.select(F.col("filter_type").alias("_dim"), F.col("filter_value").alias("_value")).distinct()
    # combined per task: as many rows as a dimension has values
    met = points.select(F.inline(offers)).groupBy("_dim", "_value").agg(F.count("*").alias("_points")).join(asked, ["_dim", "_value"])
    filled = visuals.select("*", F.inline(F.array(*[F.struct(F.lit(d).alias("_dim"), F.col(f"_{d}").alias("_value")) for d in ordered]))).filter("_value is not null")
    # a filter that no point meets rules its visual out
    ranked = filled.join(met, ["_dim", "_value"], "left").withColumn("_rank", F.struct(F.coalesce("_points", F.lit(0)).alias("points"), "_dim", "_value"))
    index = ranked.groupBy("visual_id", *[f"_{d}" for d in ordered]).agg(F.min("_rank").alias("_rank")).filter("_rank.points > 0")
    index = index.select("visual_id", *[f"_{d}" for d in ordered], "_rank._dim", "_rank._value")
    holds = reduce(and_, [F.col(f"_{d}").isNull() | F.coalesce(F.col(d).cast("string") == F.col(f"_{d}"), F.lit(False)) for d in ordered], F.lit(True))
    values = [F.col(d) for d in ordered if d != point_id]
    return (
        points.select(point_id, *values, F.inline(offers))
        .join(index, ["_dim", "_value"]).filter(holds)
        .select("visual_id", point_id)
    )
