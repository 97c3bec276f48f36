"""Fixed schemas: the engine never infers types."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# Canonical model -----------------------------------------------------------

OBSERVATION = T.StructType(
    _strings("source", "geo_type", "geo", "period_type")
    + [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
    + _strings("series", "metric", "raw_value")
    + [
        T.StructField("value", T.DoubleType()),
        T.StructField("is_suppressed", T.BooleanType()),
        T.StructField("as_of", T.DateType()),
        T.StructField("data_until", T.DateType()),
    ]
)

# Sums of a source and year that can be added up later
PARTIALS = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("year", T.IntegerType())]
    + _strings("geo_type", "geo", "series", "metric")
    + [
        T.StructField("total", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("suppressed", T.LongType()),
        T.StructField("lowest", T.DoubleType()),
        T.StructField("highest", T.DoubleType()),
        T.StructField("as_of", T.DateType()),
    ]
)

POPULATION = T.StructType(
    [
        T.StructField("geo", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("population", T.LongType()),
    ]
)

# Landed tables ---------------------------------------------------------------

INDICATOR_CSV = T.StructType(
    [T.StructField("PRUID", T.IntegerType())]
    + _strings(
        "Region", "Source", "Substance", "Specific_Measure", "Disaggregator",
        "Time_Period", "Year_Quarter", "Unit", "Value",
    )
)

POPULATION_CSV = T.StructType(
    [T.StructField("REF_DATE", T.IntegerType())]
    + _strings("GEO", "Gender", "Age group")
    + [T.StructField("VALUE", T.LongType())]
)

SAMPLE_CSV = T.StructType(
    _strings(
        "Visit Date", "City", "Health Authority", "Site", "Expected Drug", "Category",
        "Colour", "Description", "Fentanyl Strip", "Benzo Strip", "Spectrometer",
    )
)

CRIME_CSV = T.StructType(
    [T.StructField("REF_DATE", T.IntegerType())] + _strings("GEO", "Violations", "Statistics", "VALUE")
)

# Decoded cells ---------------------------------------------------------------

WORKBOOK_CELLS = "path string, sheet string, row_no int, col_no int, value string"
GRID_CELLS = "page_id long, grid_no int, row_no int, cell_no int, role string, text string"

# Published chart series ------------------------------------------------------

SERIES_ROWS = "chart string, geo string, metric string, series string, x array<string>, y array<double>"
