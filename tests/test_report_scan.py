"""The report machine over lines against the rules over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.sources import report_scan as S, reports

RACE = "Confirmed Drug Toxicity Deaths Involving Opioid Drugs by Manner of Death, Sex and Race"
DRUGS = "Breakdown of Opioid Drugs Identified in Confirmed Drug Toxicity Deaths by Manner of Death"


def race_report(rng):
    lines = ["Some words", f"This table, {RACE}, was updated"]
    for _ in range(rng.randint(1, 3)):
        lines += [rng.choice(["", "   "]), rng.choice([RACE, RACE.replace(" ", "  "), "Table 3: " + RACE])]
        if rng.random() < 0.8:
            lines.append("of the Province")
        lines.append("2016 2017 2018")
        for manner in rng.sample(reports.MANNERS, rng.randint(1, 4)):
            for n, sex in enumerate(rng.sample(["Male", "Female"], rng.randint(1, 2))):
                lines.append(f"{manner} {sex}" if n == 0 else sex)
                for race in rng.sample(["White", "Black", "Metis &", "Not known", "First Nations non -status"], rng.randint(1, 4)):
                    lines += [race, rng.choice(["others", "more &"])] if race.endswith("&") else [race]
                    if lines[-1].endswith("&"):
                        lines.append("rest")
                    lines[-1] += "  " + " ".join(rng.choice(["-", "--", "3", "12"]) for _ in range(rng.randint(2, 4)))
                    if rng.random() < 0.15:
                        lines.append(rng.choice(["Please note the change", "Race 1 2 3", RACE, "2019 2020"]))
        lines += ["", "Prose behind the table 1 2 3"]
    return "\n".join(lines)


def drug_report(rng):
    lines = ["x", "", DRUGS, "FentanylHeroinFuranylUF-17", "Codeine Morphine"]
    for year in range(2016, 2016 + rng.randint(1, 6)):
        for n, manner in enumerate(rng.sample(reports.MANNERS, rng.randint(1, 3))):
            lines.append((f"{year} " if n == 0 else "") + manner + " " + " ".join(rng.choice(["-", "4", "15"]) for _ in range(6)))
    return "\n".join([*lines, "", "end"])


@pytest.mark.parametrize("kind", ["race", "drugs"])
def test_blocks_of_any_size_read_as_whole_texts(spark, rows, kind):
    rng = random.Random(5)
    make, title, rule, machine, columns = {
        "race": (race_report, RACE, reports.sex_race, S.sex_race, ["report", "manner", "sex", "race", "year", "raw_value"]),
        "drugs": (drug_report, DRUGS, reports.manner_breakdown, S.manner_breakdown, ["report", "year", "manner", "drug", "raw_value"]),
    }[kind]
    texts = spark.createDataFrame([(n, make(rng)) for n in range(12)] + [(98, ""), (99, None)], "report int, text string")
    expected = rows(rule(reports.report_tables(texts, {title: ""})), *columns)
    assert len(expected) > 100
    lines = reports.report_lines(texts).repartition(5)
    for block_lines in (1, 3, 100_000):
        assert rows(machine(lines, {title: ""}, block_lines=block_lines), *columns) == expected


def test_transitions_compose_associatively(spark):
    """Any bracketing of the blocks gives the same transition, and the one of the whole report."""
    rng = random.Random(7)
    lines = spark.createDataFrame([(0, race_report(rng) + "\n" + race_report(rng))], "report int, text string")
    cells = S.classified(reports.report_lines(lines), {RACE: ""}).orderBy("line_no").collect()
    cells = [r.asDict() for r in cells]
    whole = S.transition(cells)
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, len(cells)), rng.randint(1, 8)))
        parts = [S.transition(cells[a:b]) for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True)]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            parts[at : at + 2] = [S.composed(parts[at], parts[at + 1])]
        assert parts[0] == whole


def test_one_report_is_dealt_over_tasks(spark, rows):
    body = [f"Accident Male\nWhite {n} {n + 1}\nBlack &\nothers {n} {n}" for n in range(400)]
    texts = spark.createDataFrame([(1, "\n".join(["", RACE, "2016 2017", *body, ""]))], "report int, text string")
    lines = reports.report_lines(texts)
    rows_of = S.classified(lines, {RACE: ""}, block_lines=50)
    assert rows_of.select("block").distinct().count() == 33
    found = S.scanned(rows_of, chunk_blocks=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a few small lines are put together again
    try:
        tasks = found.select(F.spark_partition_id().alias("t"), "line").groupBy("t").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and sum(t["count"] for t in tasks) == 800
    expected = rows(reports.sex_race(reports.report_tables(texts, {RACE: ""})), "race", "year", "raw_value")
    assert rows(S._years(found, "race"), "race", "year", "raw_value") == expected


def test_no_lines(spark):
    lines = spark.createDataFrame([], "report string, line_no int, line string")
    assert S.sex_race(lines, {RACE: ""}).isEmpty()
    lines = spark.createDataFrame([("a", 0, None), ("a", 1, RACE)], "report string, line_no int, line string")
    assert S.sex_race(lines, {RACE: ""}).isEmpty()
