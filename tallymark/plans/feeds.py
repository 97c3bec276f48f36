"""From landed files to clean tables, one function per kind of source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.functions import numbers as N, periods as P
from tallymark.functions.text import clean_label
from tallymark.operators import measures as M, ordered as O, reshape as R, select as S
from tallymark.schemas import CRIME_CSV, INDICATOR_CSV, POPULATION_CSV, SAMPLE_CSV
from tallymark.sources import archives, grids, readers, workbooks

FIRST_YEAR = 2007


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.withColumns({f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema})


# National harms ----------------------------------------------------------------


def national_harms(spark: SparkSession, archive: str) -> DataFrame:
    """Indicator rows of the zipped download, stamped with the member's date."""
    rows = archives.read_zip_csv(spark, archive, INDICATOR_CSV.names)
    typed = _typed(rows, INDICATOR_CSV)
    return typed.select(*INDICATOR_CSV.names, F.to_date("member_time").alias("as_of"))


def harms_data_until(ind: DataFrame) -> DataFrame:
    """First day after the last quarter of the country-wide deaths."""
    quarters = S.slice_indicator(ind.filter("PRUID = 1"), Time_Period="By quarter", Source="Deaths")
    return M.latest_date(quarters, P.quarter_data_until(F.col("Year_Quarter")))


# Population --------------------------------------------------------------------


def population(raw: DataFrame, since: int = FIRST_YEAR) -> DataFrame:
    """Population of all genders and ages per region and year."""
    cohort = S.slice_indicator(raw, **{"Gender": "Total - gender", "Age group": "All ages"})
    return S.from_year(cohort, "REF_DATE", since).select(
        F.col("GEO").alias("geo"), F.col("REF_DATE").alias("year"), F.col("VALUE").alias("population")
    )


def population_from_zip(spark: SparkSession, archive: str, since: int = FIRST_YEAR) -> DataFrame:
    return population(_typed(archives.read_zip_csv(spark, archive, POPULATION_CSV.names), POPULATION_CSV), since)


# Police statistics --------------------------------------------------------------


def drug_offences(raw: DataFrame, since: int = FIRST_YEAR) -> DataFrame:
    kept = S.from_year(raw, "REF_DATE", since).filter(S.has_code(F.col("Violations")))
    return kept.select(
        F.col("GEO").alias("geo"), F.col("REF_DATE").alias("year"), F.col("Violations").alias("series"),
        F.col("Statistics").alias("metric"), F.col("VALUE").alias("raw_value"), N.to_number(F.col("VALUE")).alias("value"),
    )


def drug_offences_from_zip(spark: SparkSession, archive: str, since: int = FIRST_YEAR) -> DataFrame:
    return drug_offences(_typed(archives.read_zip_csv(spark, archive, CRIME_CSV.names), CRIME_CSV), since)


# Drug checking --------------------------------------------------------------------


def samples_from_pages(pages: DataFrame) -> DataFrame:
    """Result tables of the drug-check site (one page per row) to raw samples."""
    return grids.grid_records(grids.read_grid_cells(pages), SAMPLE_CSV.names).select(*SAMPLE_CSV.names)


# Coroner dashboards ----------------------------------------------------------------


def dashboard_tables(pages: DataFrame, base_year: int, header: str = "plain") -> DataFrame:
    """Grids captured from a dashboard: ``page_id, selection, title, html`` to long observations.

    ``selection`` is the region or year that was picked on the page; it leads the table's title.
    """
    cells = grids.read_grid_cells(pages)
    names = pages.select(
        "page_id",
        F.concat_ws(": ", F.nullif(F.trim("selection"), F.lit("")), "title").alias("_name"),
    )
    long = grids.grid_long(cells.join(names, "page_id"), F.lit(""), base_year, header).drop("title")
    return long.join(names, "page_id").select(
        F.col("_name").alias("title"), "grid_no", "row_no", clean_label(F.col("label")).alias("label"), "header", "year",
        clean_label(F.col("raw_value")).alias("raw_value"), N.to_number(F.col("raw_value")).alias("value"),
        N.is_suppressed(F.col("raw_value")).alias("is_suppressed"),
    )


# Monthly workbook ------------------------------------------------------------------

# Columns of the provincial sheet behind year and month.
PROVINCIAL_SERIES = ("opioid confirmed", "opioid probable", "stimulant", "other drug")


def provincial_months(cells: DataFrame, head: int = 3, tail: int = 3) -> DataFrame:
    """Provincial sheet: title and footer rows cut off, merged years filled down, drugs to rows."""
    rows = _dense_rows(cells.filter(F.col("sheet") == "Provincial Drug Toxicity"))
    body = S.trim_rows(rows, ["path", "sheet"], "row_no", head, tail)
    columns = ["year", "month", *PROVINCIAL_SERIES]
    table = body.groupBy("path", "sheet", "row_no").pivot("col_no", list(range(len(columns)))).agg(F.first("value"))
    named = table.withColumnsRenamed({str(i): c for i, c in enumerate(columns)})
    filled = O.carry_forward(named, ["path", "sheet"], "row_no", ["year"])
    return _months(R.wide_to_long(filled.drop("row_no"), ["path", "sheet", "year", "month"], "series", "raw_value"), "series")


def unit_months(cells: DataFrame, head: int = 1, tail: int = 3) -> DataFrame:
    """Health-unit sheet: months run across, units down. Transposed, the units become series."""
    rows = _dense_rows(cells.filter(F.col("sheet") == "PHU Confirmed & Probable"))
    body = S.trim_rows(rows, ["path", "sheet"], "row_no", head, tail)
    keys = ["path", "sheet", "col_no"]
    year = body.filter(F.col("row_no") == head).filter("col_no > 0").select(*keys, F.col("value").alias("year"))
    month = body.filter(F.col("row_no") == head + 1).filter("col_no > 0").select(*keys, F.col("value").alias("month"))
    filled = O.carry_forward(month.join(year, keys, "left"), ["path", "sheet"], "col_no", ["year"])
    units = body.filter((F.col("row_no") > head + 1) & (F.col("col_no") == 0)).select(
        "path", "sheet", "row_no", F.trim("value").alias("unit")
    )
    values = body.filter((F.col("row_no") > head + 1) & (F.col("col_no") > 0)).withColumnRenamed("value", "raw_value")
    return _months(values.join(units, ["path", "sheet", "row_no"]).join(filled, keys), "unit")


def _dense_rows(cells: DataFrame) -> DataFrame:
    """Renumber the rows of a sheet without its empty rows (those hold no cells)."""
    filled = cells.select("path", "sheet", "row_no").distinct().withColumn("_one", F.lit(1))
    numbered = O.running_total(filled, ["path", "sheet"], "row_no", {"_dense": F.col("_one")})
    return (
        cells.join(numbered.select("path", "sheet", "row_no", "_dense"), ["path", "sheet", "row_no"])
        .withColumn("row_no", (F.col("_dense") - 1).cast("int")).drop("_dense")
    )


def _months(df: DataFrame, name: str) -> DataFrame:
    return df.select(
        name, F.col("year").try_cast("int").alias("year"),
        F.coalesce(F.col("month").try_cast("int"), P.month_number(F.substring("month", 1, 3))).alias("month"),
        "raw_value", N.to_number(F.col("raw_value")).alias("value"), N.is_suppressed(F.col("raw_value")).alias("is_suppressed"),
    ).filter("year is not null and month is not null")


def ontario_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    cells = workbooks.read_workbook_cells(spark, path)
    return provincial_months(cells), unit_months(cells)


# API records ------------------------------------------------------------------------


def event_records(spark: SparkSession, path: str, schema, source: str) -> DataFrame:
    """Records of an event feed (one row per patient and substance, or per administration)."""
    return readers.read_records(spark, path, schema).withColumn("source", F.lit(source))


ALL_SUBSTANCES = "Total - all substances (plus suspect cases)"


def fatalities(records: DataFrame) -> DataFrame:
    """Monthly fatalities per drug type, ``year_month`` cut to its date."""
    month = F.try_to_date(F.split_part("year_month", F.lit("T"), F.lit(1)), "yyyy-MM-dd")
    return records.withColumn("month_start", month)


def fatalities_data_until(records: DataFrame) -> DataFrame:
    totals = fatalities(records).filter(F.col("drug_type") == ALL_SUBSTANCES)
    return M.latest_date(totals, F.col("month_start"))
