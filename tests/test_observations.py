"""The canonical observation table: shape, publication, pruned reading, incremental marts."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tallymark.plans import feeds, harm_marts, observations as O, sample_marts
from tallymark.schemas import OBSERVATION
from tallymark.sources import versions


def day():
    return F.lit("2024-09-30").cast("date")


def obs(spark, rows, source="orders", as_of="2024-09-30"):
    df = spark.createDataFrame(rows, "geo string, year int, raw string")
    return O.observations(
        df, source, geo_type=F.lit("r"), geo=F.col("geo"), year=F.col("year"), period_type=F.lit("year"), series=F.lit("s"), metric=F.lit("m"),
        raw_value=F.col("raw"), as_of=F.lit(as_of).cast("date"),
    )


def values(df):
    return sorted((r["source"], r["year"] or 0, r["geo"], r["raw_value"]) for r in df.collect())


def test_shape_is_checked(spark):
    row = obs(spark, [("BC", 2020, "1,200"), ("BC", 2021, "Suppr."), ("BC", 2022, None)]).collect()
    assert [(r["value"], r["is_suppressed"]) for r in row] == [(1200.0, False), (None, True), (None, False)]
    assert obs(spark, []).schema.names == OBSERVATION.names
    good = obs(spark, [("BC", 2020, "1")])
    for change in ({"geo": F.lit(None).cast("string")}, {"period_type": F.lit("week")}, {"month": F.lit(13)}, {"period_type": F.lit("month")}, {"is_suppressed": F.lit(True)}):
        with pytest.raises(Exception, match="observation: "):
            O.checked(good.withColumns(change)).collect()
    with pytest.raises(ValueError, match="colour"):
        O.observations(good, "orders", colour=F.lit("red"))
    with pytest.raises(ValueError, match="source name"):
        O.observations(good, "../orders")


def test_later_landings_replace_their_years_only(spark, tmp_path):
    root = str(tmp_path / "t")
    assert values(O.stored(spark, root)) == []
    O.publish(obs(spark, [("a", 2019, "1"), ("a", 2020, "2"), ("b", 2020, "3"), ("a", None, "9")]), root)
    O.publish(obs(spark, [("c", 2020, "4")], "other"), root)
    O.publish(obs(spark, [("a", 2020, "20"), ("a", 2021, "21")], as_of="2025-09-30"), root)
    expected = [("orders", 0, "a", "9"), ("orders", 2019, "a", "1"), ("orders", 2020, "a", "20"), ("orders", 2021, "a", "21"), ("other", 2020, "c", "4")]
    assert values(O.stored(spark, root)) == expected
    # an empty landing and one without years
    O.publish(obs(spark, []), root)
    assert values(O.stored(spark, root)) == expected
    O.publish(obs(spark, [("z", None, "8")]), root)
    assert values(O.stored(spark, root))[0] == ("orders", 0, "z", "8")


def test_a_broken_off_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    O.publish(obs(spark, [("a", 2020, "1")]), root)
    bad = obs(spark, [("a", 2020, "2")]).withColumn("geo", F.when(F.col("geo") == "a", F.raise_error(F.lit("lost"))).otherwise(F.col("geo")))
    with pytest.raises(Exception, match="lost"):
        O.publish(bad, root)
    # data and pointer of the next generation are there, but the switch never came
    obs(spark, [("a", 2020, "3")]).write.mode("overwrite").partitionBy("source", "year").parquet(f"{root}/data/version=2")
    versions.pointer(spark, root).withColumn("version", F.lit(2).cast("long")).write.parquet(f"{root}/pointer/generation=2")
    assert values(O.stored(spark, root)) == [("orders", 2020, "a", "1")]
    O.publish(obs(spark, [("a", 2020, "4")]), root)
    assert values(O.stored(spark, root)) == [("orders", 2020, "a", "4")] and versions.generations(spark, root) == [1, 2]


def test_two_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    O.publish(obs(spark, [("a", 2020, "1")]), root)
    monkeypatch.setattr(versions, "generations", lambda spark, root: [])
    with pytest.raises(RuntimeError, match="meanwhile"):
        O.publish(obs(spark, [("a", 2020, "2")]), root)


def test_clean_up_keeps_what_is_named(spark, tmp_path):
    root = str(tmp_path / "t")
    O.publish(obs(spark, [("a", 2019, "1"), ("a", 2020, "2")]), root)
    O.publish(obs(spark, [("a", 2020, "20")]), root)
    O.publish(obs(spark, [("a", 2020, "30")]), root)
    assert versions.clean_up(spark, root, keep=3) == []
    removed = versions.clean_up(spark, root, keep=1)
    assert [re.search("version.*", p)[0] for p in removed] == ["version=1/source=orders/year=2020", "version=2/source=orders/year=2020"]
    assert values(O.stored(spark, root)) == [("orders", 2019, "a", "1"), ("orders", 2020, "a", "30")]
    O.publish(obs(spark, [("a", 2021, "5")]), root)
    assert len(values(O.stored(spark, root))) == 3 and versions.generations(spark, root) == [3, 4]


def test_slices_open_only_their_folders(spark, tmp_path):
    root = str(tmp_path / "t")
    O.publish(obs(spark, [("a", y, str(y)) for y in range(2010, 2020)]), root)
    O.publish(obs(spark, [("a", 2012, "x")], "other"), root)
    rows = O.sliced(spark, root, "orders", 2012, 2014, geo="a")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*source#\d+ = orders[^]]*year#\d+ >= 2012", plan) and "PushedFilters: [IsNotNull(geo), EqualTo(geo,a)]" in plan
    assert [v[1] for v in values(rows)] == [2012, 2013, 2014]


def test_refresh_reads_what_changed_and_equals_a_rebuild(spark, tmp_path, monkeypatch):
    root, mart = str(tmp_path / "t"), str(tmp_path / "m")
    O.publish(obs(spark, [("a", 2019, "1"), ("a", 2020, "2"), ("b", 2020, "Suppr."), ("a", None, "7")]), root)
    assert sorted((r["year"] or 0) for r in O.refresh(spark, root, mart).collect()) == [0, 2019, 2020]
    assert O.refresh(spark, root, mart).isEmpty() and versions.generations(spark, mart) == [1]
    O.publish(obs(spark, [("c", 2020, "4")], "other"), root)
    O.publish(obs(spark, [("a", 2020, "20"), ("b", 2021, "5")]), root)

    read = []
    original = O.partials

    def watched(rows):
        read.extend(rows.inputFiles())
        return original(rows)

    monkeypatch.setattr(O, "partials", watched)
    O.refresh(spark, root, mart)
    assert {re.search("source=.*/year=[^/]*", f)[0] for f in read} == {"source=other/year=2020", "source=orders/year=2020", "source=orders/year=2021"}
    for keys in (O.KEYS, ("source", "year", *O.KEYS)):
        rebuilt = O.added_up(original(O.stored(spark, root)), keys)
        assert sorted(map(str, O.mart_rows(spark, mart, keys).collect())) == sorted(map(str, rebuilt.collect()))
    # a part that is gone from the table goes from the mart
    versions.publish(O.stored(spark, root).filter("false"), root, removed=spark.createDataFrame([("other", 2020)], "source string, year int"))
    O.refresh(spark, root, mart)
    assert O.mart_rows(spark, mart).filter("source = 'other'").isEmpty() and O.mart_rows(spark, mart).count() == 4


def test_every_feed_yields_observations(spark, tmp_path):
    ind = harm_marts.typed_indicators(spark.createDataFrame(
        [("BC", "Deaths", "Opioids", "Overall numbers", None, "By year", "2024", "Number", "2339"), ("BC", "Deaths", "Opioids", "Sex", "Male", "By quarter", "2024 Q3", "Percent", "Suppr.")],
        "Region string, Source string, Substance string, Specific_Measure string, Disaggregator string, Time_Period string, Year_Quarter string, Unit string, Value string",
    ))
    people = spark.createDataFrame([("BC", 2024, 5_000_000)], "geo string, year int, population long")
    crime = feeds.drug_offences(spark.createDataFrame([(2020, "NS", "Trafficking [4140]", "Rate", "12.5")], "REF_DATE int, GEO string, Violations string, Statistics string, VALUE string"))
    months = spark.createDataFrame([("stimulant", 2024, 3, "*")], "series string, year int, month int, raw_value string")
    units = spark.createDataFrame([("Peel", 2024, 3, "7")], "unit string, year int, month int, raw_value string")
    grid = spark.createDataFrame([("Fraser: Deaths", "May", "Number", 2024, "9")], "title string, label string, header string, year int, raw_value string")
    deaths = feeds.fatalities(spark.createDataFrame([("2024-05-01T00:00:00", "All", "3")], "year_month string, drug_type string, n string"))
    samples = sample_marts.typed_samples(spark.createDataFrame(
        [("2024-03-01", "Interior Health", "Opioid", "x", "Pos", "Neg", "Fentanyl"), (None, None, None, "x", "Pos", "Neg", "Fentanyl")],
        "`Visit Date` string, `Health Authority` string, Category string, `Expected Drug` string, `Fentanyl Strip` string, `Benzo Strip` string, Spectrometer string",
    ))
    root = str(tmp_path / "t")
    for made in (
        O.indicator_observations(ind, day()), O.population_observations(people, day()), O.offence_observations(crime, day()), O.month_observations(months, day()),
        O.month_observations(units, day(), "unit", source="healthUnits"), O.dashboard_observations(grid, day()), O.fatality_observations(deaths, "n", day(), "Nova Scotia"),
        O.sample_observations(samples, day()),
    ):
        O.publish(made, root)
    found = {(r["source"], r["geo"], r["year"], r["month"], r["value"], r["is_suppressed"]) for r in O.stored(spark, root).collect()}
    assert found == {
        ("nationalHarms", "BC", 2024, None, 2339.0, False), ("nationalHarms", "BC", 2024, None, None, True),
        ("population", "BC", 2024, None, 5e6, False), ("drugOffences", "NS", 2020, None, 12.5, False), ("monthlyWorkbook", "Ontario", 2024, 3, None, True),
        ("healthUnits", "Peel", 2024, 3, 7.0, False), ("coronerDashboards", "Fraser", 2024, None, 9.0, False), ("monthlyFatalities", "Nova Scotia", 2024, 5, 3.0, False),
        ("drugChecks", "Interior", 2024, 3, 1.0, False), ("drugChecks", "Unknown", None, None, 1.0, False),
    }
    assert O.stored(spark, root).agg(F.max("as_of")).first()[0] == datetime.date(2024, 9, 30)
