"""Number coercion and the indicator formulas. Text becomes a number only through try_cast."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallymark.functions.text import NBSP, clean_label

# Marks that publishers use in place of a number.
SUPPRESSED_MARKS = ("Suppr.", "*")
ZERO_MARKS = ("-", "--")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
THOUSANDS = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"


def to_number(c: Column) -> Column:
    """``"12.3%"``, padded numbers and ``"1,234"`` to DOUBLE; everything else (words, NaN, ``12F``) to NULL."""
    text = F.trim(F.regexp_replace(c.cast("string"), f"[%{NBSP}]", ""))
    text = F.when(text.rlike(THOUSANDS), F.replace(text, F.lit(","))).otherwise(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_number_or_zero(c: Column) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def dashes_as_zero(c: Column) -> Column:
    """Tables that print dashes for none: dash -> 0, other text -> number or NULL."""
    return F.when(clean_label(c).isin(*ZERO_MARKS), F.lit(0.0)).otherwise(to_number(c))


def is_suppressed(c: Column) -> Column:
    return F.coalesce(clean_label(c).isin(*SUPPRESSED_MARKS), F.lit(False))


def half_even(c: Column, places: int = 2) -> Column:
    return F.bround(c, places)


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent, two decimals; NULL where the whole is zero."""
    return half_even(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0))


def percent_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(percent_of(part, whole), F.lit(0.0))


def rate_per_100k(count: Column, population: Column) -> Column:
    """Events per 100,000 people, two decimals; NULL without a population."""
    return half_even(F.try_divide(count.cast("double"), population.cast("double")) * F.lit(100000.0))


def rate_or_zero(count: Column, population: Column) -> Column:
    """Zero population gives rate 0; an unknown population stays NULL."""
    return F.when(population == 0, F.lit(0.0)).otherwise(rate_per_100k(count, population))


def count_from_percent(percent: Column, total: Column, truncate: bool = False) -> Column:
    """Count behind a published percentage. ``truncate`` drops the percent's decimals first."""
    pct = F.floor(percent).cast("double") if truncate else percent.cast("double")
    return half_even(pct * total.cast("double") / F.lit(100.0), 0).cast("bigint")


def axis_ceiling(peak: Column) -> Column:
    """Round a chart peak up to the next 10, 100 or 1000 by its number of digits."""
    digits = F.length(F.floor(peak).cast("string"))
    step = F.when(digits >= 4, 1000).when(digits == 3, 100).otherwise(10)
    return (F.ceil(peak / step) * step).cast("bigint")
