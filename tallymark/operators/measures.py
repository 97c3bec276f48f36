"""Counts, shares, rates and the other indicator measures.

Facts are always reduced by a plain ``groupBy`` first (partial aggregation happens before the
shuffle, so one hot key costs one row per task), and dimensions are joined to the reduced rows.
Joins carry no broadcast hints: Spark broadcasts a side only when its measured size allows it, and
splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions import numbers as N, periods as P
from tallymark.functions.text import clean_label
from tallymark.operators.groups import join_groups
from tallymark.operators.select import mentions


def tally(df: DataFrame, keys: Sequence[str | Column], weight: str | None = None, name: str = "n") -> DataFrame:
    """Rows per key; ``weight`` re-aggregates an already counted frame."""
    total = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(total.alias(name))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def share_of_total(
    df: DataFrame, by: Sequence[str], value: str, total: str = "total", share: str = "percent"
) -> DataFrame:
    """Each value's percentage of its group's total.

    The totals are a second aggregate over the same reduced rows rather than a window, so a group
    is never gathered into one task.
    """
    totals = df.groupBy(*by).agg(F.sum(value).alias(total))
    return join_groups(df, totals, by).withColumn(share, N.percent_or_zero(F.col(value), F.col(total)))


def flagged_counts(
    df: DataFrame, by: Sequence[str], flags: Mapping[str, Column], weight: str | None = None
) -> DataFrame:
    """Per group: rows, and rows for which each flag holds, in one pass."""
    unit = F.lit(1) if weight is None else F.col(weight)
    return df.groupBy(*by).agg(
        F.sum(unit).alias("total"), *[F.sum(F.when(c, unit).otherwise(0)).alias(n) for n, c in flags.items()]
    )


def flag_series(df: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Long form of :func:`flagged_counts` with the percentage of the group's rows."""
    return (
        df.unpivot([*by, "total"], list(flags), "series", "n")
        .withColumn("percent", N.percent_or_zero(F.col("n"), F.col("total")))
    )


def keyword_counts(
    df: DataFrame, by: Sequence[str], text: Column, words: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Rows whose text mentions each word. All words are counted in the same scan; a row may count
    for several words, and text that is NULL mentions none."""
    flags = {w: F.coalesce(mentions(text, w), F.lit(False)) for w in words}
    return flag_series(flagged_counts(df, by, flags, weight), by, list(words))


def token_counts(df: DataFrame, by: Sequence[str], tokens: str, weight: str | None = None) -> DataFrame:
    """Occurrences of every token, and the rows that hold it at least once.

    A row lists its tokens once with repeats and once without, so it takes time in proportion to their
    number; repeats are folded before the shuffle.
    """
    unit = F.lit(1) if weight is None else F.col(weight)
    kept = F.filter(tokens, lambda t: t != "")
    folded = F.concat(
        F.transform(kept, lambda t: F.struct(t.alias("token"), F.lit(1).alias("repeats"), F.lit(0).alias("rows"))),
        F.transform(F.array_distinct(kept), lambda t: F.struct(t.alias("token"), F.lit(0).alias("repeats"), F.lit(1).alias("rows"))),
    )
    return (
        # a plain explode would evaluate the folding a second time to test it for emptiness
        df.select(*by, unit.alias("_w"), F.explode_outer(folded).alias("_t"))
        .filter(F.col("_t").isNotNull())
        .groupBy(*by, F.col("_t.token").alias("token"))
        .agg(F.sum(F.col("_w") * F.col("_t.repeats")).alias("occurrences"), F.sum(F.col("_w") * F.col("_t.rows")).alias("samples"))
    )


def grouped_totals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts per key combination plus totals over the last key, from one rollup."""
    *outer, last = keys
    return (
        df.rollup(*keys).agg(
            F.sum(value).alias(value),
            F.grouping_id().alias("_level"),
        )
        .filter(F.col("_level") <= 1)
        .withColumn("is_total", F.col("_level") == 1)
        .drop("_level")
    )


def sum_columns(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sum of each column per group; text that is no number counts as 0."""
    return df.groupBy(*by).agg(*[F.sum(N.to_number_or_zero(F.col(c))).alias(c) for c in columns])


def year_totals(df: DataFrame, by: Sequence[str], raw: str) -> DataFrame:
    """Monthly text values to yearly totals; suppressed months are skipped and counted apart."""
    marked = df.withColumn("_hidden", N.is_suppressed(F.col(raw)))
    return marked.groupBy(*by).agg(
        F.sum(F.when(~F.col("_hidden"), N.to_number(F.col(raw)))).alias("value"),
        F.count_if("_hidden").alias("suppressed_months"),
    )


def complete_until(df: DataFrame, by: Sequence[str], raw: str, month_start: str, as_of: Column) -> DataFrame:
    """Date up to which a series is complete: its first suppressed month, else its last month if
    that lies before the publication date, else the publication date. Each series has its own."""
    hidden = F.min(F.when(N.is_suppressed(F.col(raw)), F.col(month_start)))
    return df.groupBy(*by).agg(
        F.least(hidden, F.max(month_start), F.max(as_of)).alias("complete_until")
    )


def latest_date(df: DataFrame, date: Column, name: str = "data_until") -> DataFrame:
    return df.agg(F.max(date).alias(name))


def add_rate(df: DataFrame, population: DataFrame, count: str, mode: str = "same_year") -> DataFrame:
    """Join ``population(geo, year, population)`` and add the rate per 100,000.

    ``same_year`` uses each year's own population; ``latest_year`` applies the population of the
    last year on the axis to all years, as the published national chart does.
    """
    if mode == "same_year":
        joined = df.join(population, ["geo", "year"], "left")
    elif mode == "latest_year":
        end = df.agg(F.max("year").alias("year"))
        fixed = population.join(end, "year", "left_semi").drop("year")
        joined = df.join(fixed, "geo", "left")
    else:
        raise ValueError(f"unknown population mode: {mode}")
    return joined.withColumn("rate", N.rate_or_zero(F.col(count), F.col("population")))


def add_count_from_percent(
    df: DataFrame, totals: DataFrame, on: Sequence[str], percent: str = "percent", total: str = "total",
    truncate: bool = False,
) -> DataFrame:
    """Recover counts from percentages; totals are matched by key, never by position."""
    return df.join(totals, list(on), "left").withColumn(
        "count", N.count_from_percent(F.col(percent), F.col(total), truncate)
    )


def drop_empty_measures(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Leave out every measure whose values are all zero or missing."""
    live = df.groupBy(*by).agg(F.bool_or(F.coalesce(F.col(value) != 0, F.lit(False))).alias("_live"))
    return join_groups(df, live.filter("_live"), by, "left_semi")


def partial_period_notes(df: DataFrame, label: str, geo: str) -> DataFrame:
    """For every partial period: the regions that have only part of it, in one line of text."""
    partial = df.filter(P.is_partial(F.col(label))).select(
        P.period_year(F.col(label)).alias("year"), P.period_months(F.col(label)).alias("months"),
        F.col(geo).alias("_geo"),
    ).distinct()
    # after the distinct a group holds one row per region
    regions = F.array_join(F.sort_array(F.collect_list("_geo")), ", ")
    return partial.groupBy("year", "months").agg(regions.alias("regions")).withColumn(
        "note", F.concat("regions", F.lit(" contain data only for "), "months", F.lit(" in the year "), "year", F.lit("."))
    )


def observe(df: DataFrame, raw: str) -> DataFrame:
    """Keep the printed text and add its typed value and suppression flag."""
    return df.withColumns({
        "raw_value": clean_label(F.col(raw)),
        "value": N.to_number(F.col(raw)),
        "is_suppressed": N.is_suppressed(F.col(raw)),
    })
