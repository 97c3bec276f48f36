"""Dates and period labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallymark.functions.text import clean_label, no_nbsp


def stamp_to_date(c: Column) -> Column:
    """``YYYYMMDD`` or ``YYYYMM`` text to DATE; NULL for anything else."""
    day = F.when(c.rlike(r"^\d{8}$"), c).when(c.rlike(r"^\d{6}$"), F.concat(c, F.lit("01")))
    return F.try_to_date(day, "yyyyMMdd")


def long_date(c: Column) -> Column:
    return F.date_format(c, "MMMM dd, yyyy")


def month_and_year(c: Column) -> Column:
    return F.date_format(c, "MMMM, yyyy")


def period_year(label: Column) -> Column:
    """Leading year of ``"2024"``, ``"2024 Q3"``, ``"2025 (Jan to Mar)"``."""
    return F.regexp_extract(clean_label(label), r"^(\d{4})", 1).try_cast("int")


def period_months(label: Column) -> Column:
    """Month range inside the brackets of a partial-year label, else NULL."""
    months = F.trim(F.regexp_extract(no_nbsp(label), r"\(([^)]*)\)", 1))
    return F.when(is_partial(label), months)


def is_partial(label: Column) -> Column:
    return F.coalesce(label.contains("to"), F.lit(False))


def month_number(name: Column) -> Column:
    """Three-letter English month name to its number."""
    return F.month(F.try_to_date(F.concat(F.lit("2000 "), F.initcap(F.trim(name)), F.lit(" 1")), "yyyy MMM d"))


def quarter_data_until(label: Column) -> Column:
    """First day after the quarter named by ``"2024 Q3"``."""
    pattern = r"^(\d{4}) *Q([1-4])$"
    year = F.regexp_extract(clean_label(label), pattern, 1).try_cast("int")
    quarter = F.regexp_extract(clean_label(label), pattern, 2).try_cast("int")
    start = F.make_date(year, quarter * 3 - 2, F.lit(1))
    return F.add_months(start, 3)
