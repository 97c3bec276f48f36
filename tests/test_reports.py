"""Report rules on lines as the text extraction leaves them."""

from pyspark.sql import functions as F

from tallymark.sources import reports as R

REPORT = """Preface
Confirmed & Suspected Drug Toxicity Deaths by Manner of Death are shown below
1 2 3

Confirmed &  Suspected Drug Toxicity Deaths by Manner of  Death
2016 2017 2018 Total
Accident 80 90 -- 170
Confirmed Cases Homicide 1 2 3 6
Suspected Cases Suspected 0 1 2 3
Total 81 93 5 179
Please note that cases change 9 9 9
\x20\x20
Breakdown of Opioid Drugs Identified in Confirmed Drug Toxicity Deaths by Manner of Death
CodeineFentanyl
FuranylFentanyl Opioid(Unknown)FuranylUF-17
2016 Accident 1 2 3 4 5
Suicide 1 1 1 1 --
2017 Accident 7 8 9 1 2

Confirmed Drug Toxicity Deaths by Place of Death
2016 2017 2018
North Battleford 1 - 2
Confirmed Drug Toxicity Deaths by Place of Death
Total 1 - 2

Confirmed Drug Toxicity Deaths by Place of Death
2016 2017 2018
Regina 5 6 7"""

SEX_RACE = """Confirmed Drug Toxicity Deaths Involving Fentanyl by Manner of Death, Sex and Race
2016 2017
Accident Male
White &
Other 1 2
First Nations 3 4
Female
White 5 6
Suicide Male
White 7 -
"""

SEX_AGE = """Confirmed Drug Toxicity Deaths Involving Fentanyl by Manner of Death, Sex and Age Group
2016 2017
Accident Male 10 – 19 1 - 
20 – 29 3 4
60 +
9 9
Female 10 - 19 5 6
Total 1 2
"""

FENTANYL_PLACE = """Breakdown of Fentanyl (F), Carfentanyl (C), Acetylfentanyl (A), Furanylfentanyl (FF), Para-fluorofentanyl (PF) & Methylfentanyl (MF) Identified in Confirmed Drug Toxicity Deaths by Place of Death
2016 2017 2018
F F C F C
Prince Albert 1 2 - 4 5
"""

METH = """Number of Confirmed Deaths Where Methamphetamine Toxicity was Part of the Cause of Death
2016 – 2018

Year Sole Combined Total
2016 1 2 3
2017 - 4 4
"""


def read(spark, text, rule, **options):
    return R.read_tables(spark.createDataFrame([("r", text)], "report_id string, text string"), rule, **options)


def test_lines(spark, rows):
    df = spark.createDataFrame([("r", "a\nb\n")], "report_id string, text string")
    assert rows(R.report_lines(df)) == [("r", 0, "a"), ("r", 1, "b"), ("r", 2, "")]


def test_confirmed_and_suspected(spark, rows):
    out = read(spark, REPORT, "confirmed_suspected")
    assert rows(out, "manner", "year", "raw_value") == sorted([
        ("Accident-Confirmed", 2016, "80"), ("Accident-Confirmed", 2017, "90"), ("Accident-Confirmed", 2018, "--"),
        ("Homicide-Confirmed", 2016, "1"), ("Homicide-Confirmed", 2017, "2"), ("Homicide-Confirmed", 2018, "3"),
        ("Suspected", 2016, "0"), ("Suspected", 2017, "1"), ("Suspected", 2018, "2"),
        ("Total", 2016, "81"), ("Total", 2017, "93"), ("Total", 2018, "5"),
    ], key=repr)
    assert {r[0] for r in rows(out, "title")} == {"Confirmed & Suspected Drug Toxicity Deaths by Manner of Death"}


def test_manner_breakdown_carries_years(spark, rows):
    out = read(spark, REPORT, "manner_breakdown")
    table = {(r.year, r.manner, r.drug): r.raw_value for r in out.collect()}
    assert len(table) == 15
    assert table[2016, "Suicide", "FuranylUF-17"] == "--"
    assert table[2016, "Accident", "FuranylFentanyl"] == "3"
    assert table[2017, "Accident", "Opioid(Unknown)"] == "1"


def test_place_of_death_with_continued_table(spark, rows):
    out = read(spark, REPORT, "place")
    places = {(r.location, r.year): r.raw_value for r in out.collect()}
    assert places["NorthBattleford", 2017] == "-"
    assert places["Regina", 2018] == "7"
    assert places["Total", 2018] == "2"
    assert out.select("table_no").distinct().count() == 2


def test_title_in_prose_or_inside_a_table_starts_nothing(spark):
    # the prose mention and the title repeated before the blank line open no further tables
    frame = spark.createDataFrame([("r", REPORT)], "report_id string, text string")
    assert R.report_tables(frame, R.enabled_titles()).count() == 4


def test_sex_and_race(spark, rows):
    out = read(spark, SEX_RACE, "sex_race")
    assert rows(out, "manner", "sex", "race", "year", "raw_value") == sorted([
        ("Accident", "Male", "White&Other", 2016, "1"), ("Accident", "Male", "White&Other", 2017, "2"),
        ("Accident", "Male", "FirstNations", 2016, "3"), ("Accident", "Male", "FirstNations", 2017, "4"),
        ("Accident", "Female", "White", 2016, "5"), ("Accident", "Female", "White", 2017, "6"),
        ("Suicide", "Male", "White", 2016, "7"), ("Suicide", "Male", "White", 2017, "-"),
    ], key=repr)


def test_sex_and_age(spark, rows):
    out = read(spark, SEX_AGE, "sex_age")
    assert rows(out, "manner", "sex", "age_group", "year", "raw_value") == sorted([
        ("Accident", "Male", "10-19", 2016, "1"), ("Accident", "Male", "10-19", 2017, "-"),
        ("Accident", "Male", "20-29", 2016, "3"), ("Accident", "Male", "20-29", 2017, "4"),
        ("Accident", "Male", "60+", 2016, "9"), ("Accident", "Male", "60+", 2017, "9"),
        ("Accident", "Female", "10-19", 2016, "5"), ("Accident", "Female", "10-19", 2017, "6"),
        ("Accident", "Male&Female", "Total", 2016, "1"), ("Accident", "Male&Female", "Total", 2017, "2"),
    ], key=repr)


def test_fentanyl_by_place(spark, rows):
    out = read(spark, FENTANYL_PLACE, "fentanyl_place")
    assert rows(out, "location", "year", "drug", "raw_value") == sorted([
        ("PrinceAlbert", 2016, "F", "1"), ("PrinceAlbert", 2017, "F", "2"), ("PrinceAlbert", 2017, "C", "-"),
        ("PrinceAlbert", 2018, "F", "4"), ("PrinceAlbert", 2018, "C", "5"),
    ], key=repr)


def test_leftover_title_line_does_not_end_the_table(spark, rows):
    out = read(spark, METH, "sole_or_combined", leftovers="2016 –")
    assert rows(out, "year", "series", "raw_value") == sorted([
        (2016, "sole cause", "1"), (2016, "combined cause", "2"), (2016, "total", "3"),
        (2017, "sole cause", "-"), (2017, "combined cause", "4"), (2017, "total", "4"),
    ], key=repr)


def test_benzodiazepines_share_the_race_layout(spark):
    text = SEX_RACE.replace("Involving Fentanyl by Manner of Death, Sex and Race", "Involving Benzodiazepines\nRace")
    out = read(spark, text, "benzodiazepines")
    assert out.count() == 8
    assert out.first().title.endswith("Benzodiazepines by Manner of Death, Sex and Race")


def test_long_report_needs_no_shuffle(spark):
    plan = read(spark, REPORT, "place")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_very_long_table(spark):
    body = "\n".join(f"Place{'abcdefghij'[i % 10]} {i} - 2" for i in range(30_000))
    out = read(spark, "Confirmed Drug Toxicity Deaths by Place of Death\n2016 2017 2018\n" + body, "place")
    assert out.count() == 90_000
    assert out.select(F.countDistinct("location")).first()[0] == 10
