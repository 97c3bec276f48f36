"""Marts on small landed tables, with the numbers of published charts where there are some."""

import pytest
from pyspark.sql import functions as F

from tallymark.plans import harm_marts as H, sample_marts as S
from tallymark.schemas import INDICATOR_CSV, SAMPLE_CSV
from tallymark.operators import reshape as R

# PRUID, Region, Source, Substance, Specific_Measure, Disaggregator, Time_Period, Year_Quarter, Unit, Value
SK, BY = "Saskatchewan", "By year"
INDICATORS = [
    (59, "British Columbia", "Deaths", "Opioids", "Overall numbers", None, BY, "2024", "Number", "2339"),
    (59, "British Columbia", "Deaths", "Opioids", "Overall numbers", None, BY, "2025 (Jan to Mar) ", "Number", "448"),
    (59, "British Columbia", "Hospital", "Opioids", "Overall numbers", None, BY, "2024", "Number", "1"),
    (11, "Prince Edward Island", "Deaths", "Opioids", "Overall numbers", None, BY, "2025 (Jan to Mar)", "Number", "Suppr."),
    (1, "Canada", "Deaths", "Opioids", "Overall numbers", None, BY, "2024", "Number", "7225"),
    (1, "Canada", "Deaths", "Opioids", "Overall numbers", None, "By quarter", "2024 Q3", "Number", "1500"),
    (47, SK, "Deaths", "Opioids", "Overall numbers", None, BY, "2023", "Number", "300"),
    (47, SK, "Deaths", "Opioids", "Overall numbers", None, BY, "2024", "Number", "237"),
    (47, SK, "Deaths", "Stimulants", "Overall numbers", None, BY, "2024", "Number", "100"),
    (47, SK, "Deaths", "Opioids", "Age group", "20 to 29", BY, "2024", "Percent", "12.5%"),
    (47, SK, "Deaths", "Opioids", "Age group", "20 to 29", BY, "2024", "Crude rate", "99"),
    (47, SK, "Deaths", "Opioids", "Age group", "30 to 39", BY, "2023", "Percent", "50 "),
    (47, SK, "Deaths", "Opioids", "Type of opioids", "Fentanyl", BY, "2024", "Percent", "80"),
    (47, SK, "Deaths", "Stimulants", "Type of stimulants", "Cocaine", BY, "2024", "Percent", "40"),
    (48, "Alberta", "Deaths", "Stimulants", "Type of stimulants", "Cocaine", BY, "2024", "Percent", "0"),
    (47, SK, "Deaths", "Opioids", "Sex", "Male", BY, "2023", "Percent", "70.9"),
    (47, SK, "Deaths", "Opioids", "Sex", "Male", BY, "2024", "Percent", "60"),
    (47, SK, "Deaths", "Stimulants", "Sex", "Male", BY, "2024", "Percent", "70"),
    (47, SK, "Deaths", "Opioids", "Sex", "Male", BY, "2024", "Crude rate", "21.4"),
    (47, SK, "Deaths", "Opioids", "Manner of death", "Accident", BY, "2024", "Percent", "90"),
    (47, SK, "Deaths", "Stimulants", "Manner of death", "Accident", BY, "2024", "Percent", None),
]
POPULATION = [
    ("British Columbia", 2024, 5_698_430), ("British Columbia", 2025, 5_700_000), (SK, 2023, 1_200_000), (SK, 2024, 1_250_000),
    ("Prince Edward Island", 2025, 178_000),
]


@pytest.fixture(scope="module")
def ind(spark):
    return H.typed_indicators(spark.createDataFrame(INDICATORS, INDICATOR_CSV)).cache()


@pytest.fixture(scope="module")
def population(spark):
    return spark.createDataFrame(POPULATION, "geo string, year int, population bigint")


LONG = ("substance", "series", "year", "metric", "value")


def test_age_needs_the_percent_unit(ind, rows):
    assert rows(H.deaths_by_age(ind), *LONG) == sorted([
        ("Opioids", "20 to 29", 2024, "percentages", 12.5), ("Opioids", "20 to 29", 2024, "counts", 30.0),
        ("Opioids", "30 to 39", 2023, "percentages", 50.0), ("Opioids", "30 to 39", 2023, "counts", 150.0),
    ], key=repr)


def test_drug_types_use_their_own_totals_and_drop_empty_measures(ind, population, rows):
    out = H.deaths_by_drug_type(ind, population)
    assert {r[0] for r in rows(out, "geo")} == {SK}
    assert rows(out.filter("metric = 'counts'"), "series", "value") == [("Cocaine", 40.0), ("Fentanyl", 190.0)]
    assert rows(out.filter("metric = 'rates'"), "series", "value") == [("Cocaine", 3.2), ("Fentanyl", 15.2)]


def test_sex_is_aligned_by_year(ind, rows):
    out = H.deaths_by_sex(ind)
    counts = rows(out.filter("metric = 'counts'"), "substance", "year", "value")
    # the shorter stimulant series gets 0 for the year it lacks; its counts come from its own total
    assert counts == [("Opioids", 2023, 213.0), ("Opioids", 2024, 142.0), ("Stimulants", 2023, None), ("Stimulants", 2024, 70.0)]
    assert rows(out.filter("metric = 'rates'"), "substance", "value") == [("Opioids", 21.4)]


def test_sex_options_follow_the_published_charts(ind, rows):
    out = H.deaths_by_sex(ind, total_substance="Opioids", truncate=True).filter("metric = 'counts'")
    assert rows(out, "substance", "year", "value") == [
        ("Opioids", 2023, 210.0), ("Opioids", 2024, 142.0), ("Stimulants", 2023, 0.0), ("Stimulants", 2024, 166.0),
    ]


def test_manner_leaves_out_the_empty_stimulant_measure(ind, population, rows):
    out = H.deaths_by_manner(ind, population)
    assert rows(out, "substance", "series", "metric", "value") == sorted([
        ("Opioids", "Accident", "percentages", 90.0), ("Opioids", "Accident", "counts", 213.0), ("Opioids", "Accident", "rates", 17.04),
    ], key=repr)


def test_national_deaths(ind, population, rows):
    out = H.national_deaths(ind, population)
    got = {(r.code, r.year): r for r in out.collect()}
    assert got["bc", 2024].rate == 41.05 and got["bc", 2024]["count"] == 2339
    assert got["bc", 2025].is_partial and got["bc", 2025].label == "2025 (Jan to Mar)"
    assert got["pe", 2025].is_suppressed and got["pe", 2025].rate is None and got["pe", 2025].raw_value == "Suppr."
    assert len(got) == 5 and "Canada" not in {r.geo for r in got.values()}


def test_year_tables(spark, rows):
    counts = spark.createDataFrame([("Fraser ", "10", " "), ("British Columbia", "370", "400")], "`HA_Name ` string, `2014 ` string, `2015` string")
    rates = counts.withColumnRenamed("HA_Name ", "Health Authority ")
    out = H.regional_heatmap(counts, rates, "HA_Name ", "Health Authority ")
    assert out.count() == 8
    assert rows(out.filter("metric = 'counts'"), "geo", "year", "value") == [
        ("British Columbia", 2014, 370.0), ("British Columbia", 2015, 400.0), ("Fraser", 2014, 10.0), ("Fraser", 2015, None),
    ]


def test_deaths_per_drug_match_published(spark, rows):
    percents = spark.createDataFrame([("Fentanyl", "24.7%", "84.5 %"), ("Cocaine", "37.3%", None)], "Drug string, `2014` string, `2023` string")
    totals = spark.createDataFrame([("BC", 2023, 2551), ("BC", 2014, 370)], "geo string, year int, total int")
    population = spark.createDataFrame([("BC", 2014, 4_700_000), ("BC", 2023, 5_600_000)], "geo string, year int, population bigint")
    out = H.deaths_per_drug(percents, totals, population, "Drug", "BC").filter("metric = 'counts'")
    assert rows(out, "series", "year", "value") == [("Cocaine", 2014, 138.0), ("Cocaine", 2023, None), ("Fentanyl", 2014, 91.0), ("Fentanyl", 2023, 2156.0)]


def test_age_tables_split_the_total(spark, rows):
    counts = spark.createDataFrame([("<19", "5"), ("Not available", ""), ("Total ", "370")], "Age string, `2014 ` string")
    rates = spark.createDataFrame([("<19", "0.6")], "Age string, `2014 ` string")
    out = H.deaths_by_age_tables(counts, rates, "Age", "BC")
    assert rows(out, "series", "metric", "value", "is_total") == sorted([
        ("<19", "counts", 5.0, False), ("Age Unavailable", "counts", None, False), ("Total", "counts", 370.0, True), ("<19", "rates", 0.6, False),
    ], key=repr)


def test_sex_titles(spark, rows):
    tables = spark.createDataFrame([
        ("Fraser Health Authority: Unregulated Drug Deaths by Sex", "Female", 2024, "5"),
        ("Fraser Health Authority: Sex-Specific Unregulated Drug Death Rates", "Male", 2024, "1.5"),
        ("British Columbia Health Authority: Unregulated Drug Deaths by Sex", "Male", 2024, "9"),
    ], "title string, label string, year int, raw_value string")
    assert rows(H.sex_by_authority(tables), "geo", "series", "metric", "value") == [("Fraser", "female", "counts", 5.0), ("Fraser", "male", "rates", 1.5)]


def test_report_totals_types_and_places(spark, rows):
    manner = spark.createDataFrame([("Accident-Confirmed", 2016, "100"), ("Suicide-Confirmed", 2016, "9"), ("Homicide-Confirmed", 2016, "--"), ("Suspected", 2016, "7"), ("Total", 2016, "116")], "manner string, year int, raw_value string")
    totals = H.confirmed_totals(manner)
    assert rows(totals) == [(2016, 109)]
    drugs = spark.createDataFrame([(2016, "Accident", "Codeine", "6"), (2016, "Suicide", "Codeine", "4"), (2016, "Accident", "FuranylUF-17", "--")], "year int, manner string, drug string, raw_value string")
    population = spark.createDataFrame([("SK", 2016, 0)], "geo string, year int, population bigint")
    out = H.deaths_by_opioid_type(drugs, totals, population, "SK")
    assert rows(out, "series", "metric", "value") == sorted([
        ("Codeine", "counts", 10.0), ("Codeine", "percentages", 9.17), ("Codeine", "rates", 0.0),
        ("Furanyl UF-17", "counts", 0.0), ("Furanyl UF-17", "percentages", 0.0), ("Furanyl UF-17", "rates", 0.0),
    ], key=repr)
    places = spark.createDataFrame([("Regina", 2016, "5"), ("Total", 2016, "7"), ("Mars", 2016, "-")], "location string, year int, raw_value string")
    region_map = spark.createDataFrame([("Regina", "South", 0)], "location string, authority string, position int")
    assert rows(H.deaths_by_place(places, region_map)) == [("Saskatchewan", 2016, 7), ("South", 2016, 5), ("Unknown", 2016, 0)]


def test_monthly_totals_match_published(spark, rows):
    # 2018 and 2024 totals of four series, spread over two months each
    series = {"opioid confirmed": (1506, 1552), "opioid probable": (0, 289), "stimulant": (270, 286), "other drug": (211, 104)}
    data = [(s, y, m, str(v - v // 3 if m == 1 else v // 3), "2024-12-01") for s, pair in series.items() for y, v in zip((2018, 2024), pair) for m in (1, 2)]
    data.append(("stimulant", 2024, 3, "*", "2024-12-01"))
    df = spark.createDataFrame(data, "series string, year int, month int, raw_value string, as_of string").withColumn("as_of", F.to_date("as_of"))
    out = H.provincial_drug_totals(df)
    assert rows(out.filter("series = 'all drugs'"), "year", "value") == [(2018, 1987.0), (2024, 2231.0)]
    until = {r.series: str(r.complete_until) for r in out.collect()}
    assert until["stimulant"] == "2024-03-01" and until["other drug"] == "2024-02-01" and until["all drugs"] == "2024-02-01"


def test_unit_totals_keep_the_province_apart(spark, rows):
    df = spark.createDataFrame([("All", 2018, 1, "9"), ("Algoma", 2018, 1, "4"), ("Toronto", 2018, 1, "5")], "unit string, year int, month int, raw_value string")
    out = H.unit_year_totals(df)
    sums = dict(rows(out.groupBy("geo_type").agg(F.sum("value").alias("v"))))
    assert sums == {"province": 9.0, "health_unit": 9.0}


def test_bundle_has_one_row_per_series(ind, population, rows):
    bundle = H.province_bundle({"age": H.deaths_by_age(ind), "types": H.deaths_by_drug_type(ind, population)})
    got = {(r.chart, r.metric, r.series): (r.x, r.y) for r in bundle.collect()}
    assert got["types", "counts", "Fentanyl"] == (["2024"], [190.0])
    assert len(got) == 10


# Samples ---------------------------------------------------------------------------


def sample(date, ha, category, fentanyl, benzo, spectrometer):
    return (date, "City", ha, "Site", "x", category, "Blue", "d", fentanyl, benzo, spectrometer)


SAMPLES = [
    sample("2024-03-01", "Interior Health", "Opioid", "Pos", "Neg", "Fentanyl, Caffeine"),
    sample("2024-03-01", "Interior Health", "Opioid", "Pos", "Pos", "Acetylfentanyl, Fentanyl, Fentanyl"),
    sample("2023-05-09", None, "Stimulant", "Neg", "Neg", "Cocaine"),
    sample("2018-01-02", "Fraser Health", "Opioid", None, None, None),
]


@pytest.fixture(scope="module")
def samples(spark):
    return S.typed_samples(spark.createDataFrame(SAMPLES, SAMPLE_CSV))


def test_supply_has_every_year_and_category(samples, rows):
    out = S.supply_by_category(samples, S.sample_axis(2024))
    assert out.count() == 14
    assert rows(out.filter("year = 2024"), "category", "n", "total", "percent") == [("Opioid", 2, 2, 100.0), ("Stimulant", 0, 2, 0.0)]
    assert rows(out.filter("year = 2020"), "n", "percent") == [(0, 0.0), (0, 0.0)]


def test_strips(samples, rows):
    out = S.strip_positivity(samples)
    assert rows(out, "year", "series", "n", "percent") == sorted([
        (2018, "Fentanyl", 0, 0.0), (2018, "Benzodiazepines", 0, 0.0), (2023, "Fentanyl", 0, 0.0), (2023, "Benzodiazepines", 0, 0.0),
        (2024, "Fentanyl", 2, 100.0), (2024, "Benzodiazepines", 1, 50.0),
    ], key=repr)


def test_opioid_types(samples, rows):
    out = S.opioid_types(samples).filter("n > 0")
    assert rows(out, "year", "series", "n", "total") == [(2024, "Fentanyl", 2, 2)]
    assert S.opioid_types(samples).count() == 2 * len(S.OPIOIDS)


def test_regions(samples, rows):
    assert rows(S.regional_supply(samples)) == sorted([
        ("Interior", 2024, "Opioid", 2, False), ("Interior", 2024, None, 2, True), ("Fraser", 2018, "Opioid", 1, False), ("Fraser", 2018, None, 1, True),
    ], key=repr)
    assert rows(S.regional_findings(samples), "geo", "token", "occurrences", "samples") == sorted([
        ("Interior", "Acetylfentanyl", 1, 1), ("Interior", "Caffeine", 1, 1), ("Interior", "Fentanyl", 3, 2),
    ], key=repr)


def test_supply_series(samples):
    long = S.supply_series(S.supply_by_category(samples, R.year_axis(2023, 2024)), "supply", "bc", "category")
    assert long.filter("metric = 'percentages' and year = 2023 and series = 'Stimulant'").first().value == 100.0


def test_line_items_are_not_held_before_the_joins(spark, rows, tmp_path):
    """Line items are nearly unique in part and supplier: they are neither counted nor sorted by them, whatever is broadcast."""
    from datetime import date

    from tallymark.plans.mart_queries import _counts

    items = [(p, s, date(2020 + (p or 0) % 2, 1, 1), f, r) for p in (1, 2, 2, 3, 9, None) for s, f, r in ((1, "F", "R"), (2, "O", "A"), (7, "F", "N"), (None, "F", "N"))]
    tables = {
        "lineitem": (items, "l_partkey bigint, l_suppkey bigint, l_shipdate date, l_linestatus string, l_returnflag string"),
        "part": ([(1, "x"), (2, "y"), (2, "z"), (3, None)], "p_partkey bigint, p_type string"),
        "supplier": ([(1, 0), (2, 1), (2, 1), (3, 0)], "s_suppkey bigint, s_nationkey int"),
        "nation": ([(0, "A"), (1, "B")], "n_nationkey int, n_name string"),
    }
    for name, (found, ddl) in tables.items():
        spark.createDataFrame(found, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    expected = {}
    for part, supplier, day, status, _ in items:
        for nation in [n for k, n in tables["supplier"][0] if k == supplier]:
            for category in [c for k, c in tables["part"][0] if k == part]:
                key = ("AB"[nation], day.year, "Opioids" if status == "F" else "Stimulants", category)
                expected[key] = expected.get(key, 0) + 1
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            found = _counts(spark, str(tmp_path), F.col("category").alias("series"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "keys=[l_partkey" not in plan and "keys=[l_suppkey" not in plan and "Sort [l_partkey" not in plan
            assert rows(found, "geo", "year", "substance", "series", "n") == sorted(((*k, n) for k, n in expected.items()), key=repr)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
