import datetime

from pyspark.sql import functions as F

from tallymark.functions import numbers as N, periods as P, text as X


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ",".join(f"{k} {t}" for k, t in _types(values)))
    return frame.select(column.alias("out")).first()["out"]


def _types(values):
    names = {int: "int", float: "double", str: "string"}
    return [(k, names.get(type(v), "string")) for k, v in values.items()]


def test_labels(spark):
    assert one(spark, X.clean_label(F.col("c")), c=" Interior ") == "Interior"
    assert one(spark, X.lookup_key(F.col("c")), c="Death Rates per 100,000 people") == "deathratesper100"
    assert X.lookup_term("Death Rates per 100,000 people") == "deathratesper100"
    assert one(spark, X.title_case(F.col("c")), c="northern  HEALTH (east side)") == "Northern  Health (East Side)"
    assert one(spark, X.sentence_case(F.col("c")), c="nEW data") == "New data"
    assert one(spark, X.fill_template(F.lit("Deaths from replace_me"), "replace_me", F.col("c")), c="x$1") == "Deaths from x$1"
    assert one(spark, X.relabel(F.col("c"), X.DRUG_LABELS), c="FuranylUF-17") == "Furanyl UF-17"
    assert one(spark, X.relabel(F.col("c"), X.DRUG_LABELS), c="Codeine") == "Codeine"


def test_joined_headers_and_line_parts(spark):
    tokens = one(spark, X.capital_tokens(F.col("c")), c="FentanylHeroinFuranylUF-17 Opioid(Unknown)U-47700*")
    assert tokens == ["Fentanyl", "Heroin", "FuranylUF-17", "Opioid(Unknown)", "U-47700*"]
    assert one(spark, X.label_part(F.col("c")), c="North Battleford 1 - 2") == "NorthBattleford"
    assert one(spark, X.value_parts(F.col("c")), c="North Battleford 1  - 2") == ["1", "-", "2"]


def test_numbers(spark):
    assert one(spark, N.to_number(F.col("c")), c="24.7% ") == 24.7
    assert one(spark, N.to_number(F.col("c")), c="Suppr.") is None
    assert one(spark, N.to_number_or_zero(F.col("c")), c="") == 0
    assert one(spark, N.dashes_as_zero(F.col("c")), c="--") == 0
    assert one(spark, N.is_suppressed(F.col("c")), c="*") is True
    assert one(spark, N.is_suppressed(F.col("c")), c="-") is False


def test_published_percentages_and_counts(spark):
    # numbers printed in the published charts
    assert one(spark, N.percent_of(F.col("a"), F.col("b")), a=2585, b=4759) == 54.32
    assert one(spark, N.percent_of(F.col("a"), F.col("b")), a=8, b=4759) == 0.17
    assert one(spark, N.percent_of(F.col("a"), F.col("b")), a=2769, b=4759) == 58.18
    assert one(spark, N.percent_of(F.col("a"), F.col("b")), a=1522, b=2769) == 54.97
    assert one(spark, N.percent_of(F.col("a"), F.col("b")), a=10, b=109) == 9.17
    assert one(spark, N.percent_of(F.col("a"), F.col("b")), a=257, b=371) == 69.27
    assert one(spark, N.count_from_percent(F.col("p"), F.col("t")), p=24.7, t=370) == 91
    assert one(spark, N.count_from_percent(F.col("p"), F.col("t")), p=84.5, t=2551) == 2156
    assert one(spark, N.count_from_percent(F.col("p"), F.col("t"), truncate=True), p=24.7, t=370) == 89


def test_zero_guards(spark):
    assert one(spark, N.percent_or_zero(F.col("a"), F.col("b")), a=3, b=0) == 0
    assert one(spark, N.rate_or_zero(F.col("a"), F.col("b")), a=3, b=0) == 0
    assert one(spark, N.rate_per_100k(F.col("a"), F.col("b")), a=807, b=5_699_000) == 14.16


def test_axis_ceiling(spark):
    ends = [one(spark, N.axis_ceiling(F.col("p")), p=p) for p in (7, 41, 448, 2820)]
    assert ends == [10, 50, 500, 3000]


def test_periods(spark):
    day = datetime.date
    assert one(spark, P.stamp_to_date(F.col("c")), c="20240930") == day(2024, 9, 30)
    assert one(spark, P.stamp_to_date(F.col("c")), c="202408") == day(2024, 8, 1)
    assert one(spark, P.stamp_to_date(F.col("c")), c="2024") is None
    assert one(spark, P.stamp_to_date(F.col("c")), c="20241332") is None
    assert one(spark, P.long_date(F.lit("2024-09-03").cast("date")), c="") == "September 03, 2024"
    assert one(spark, P.month_and_year(F.lit("2024-09-03").cast("date")), c="") == "September, 2024"
    assert one(spark, P.period_year(F.col("c")), c="2025 (Jan to Mar) ") == 2025
    assert one(spark, P.period_months(F.col("c")), c="2025 (Jan to Mar)") == "Jan to Mar"
    assert one(spark, P.period_months(F.col("c")), c="2024") is None
    assert one(spark, P.month_number(F.col("c")), c="sep") == 9
    ends = [one(spark, P.quarter_data_until(F.col("c")), c=f"2024 Q{q}") for q in (1, 2, 3, 4)]
    assert ends == [day(2024, 4, 1), day(2024, 7, 1), day(2024, 10, 1), day(2025, 1, 1)]


def test_only_numbers_become_numbers(spark):
    texts = ["12.3%", " 1,234 ", "12F", "NaN", "Infinity", "1e3", "-.5", "12,34", "", None, "7 ", "1,234,567.5"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = [r["n"] for r in df.select("k", N.to_number(F.col("t")).alias("n")).orderBy("k").collect()]
    assert found == [12.3, 1234.0, None, None, None, 1000.0, -0.5, None, None, None, 7.0, 1234567.5]
