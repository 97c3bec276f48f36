"""Landed bytes to tables, and tables back to disk."""

import json
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from tallymark.operators import presentation as V
from tallymark.plans import feeds
from tallymark.schemas import INDICATOR_CSV, POPULATION_CSV, SAMPLE_CSV
from tallymark.sources import archives, grids, landing, readers, sinks, workbooks
from tallymark.streaming.feed import checkpoint_root, load_feed

# Files ---------------------------------------------------------------------------


@pytest.fixture
def output(tmp_path):
    folder = tmp_path / "output"
    folder.mkdir()
    header = ",".join(SAMPLE_CSV.names)
    row = "2024-03-01,City,Interior Health,Site,Opioid,Opioid,Blue,Powder,Pos,Neg,\"Fentanyl, Caffeine\""
    (folder / "20240930_20240901_drugChecks.csv").write_text(f"{header}\n{row}\n{row}\n")
    (folder / "20240830_20240801_drugChecks.csv").write_text(f"{header}\n{row}\n")
    (folder / "20240930_202408_coronerReport.xlsx").write_bytes(b"-")
    (folder / "20240901_drugWorkbook_2.xlsx").write_bytes(b"-")
    (folder / "notes.txt").write_text("x")
    return str(folder)


def test_catalogue_reads_names(spark, rows, output):
    files = landing.catalogue(spark, output).select("source", F.col("as_of").cast("string"), F.col("data_until").cast("string"), "format")
    assert rows(files) == [
        ("coronerReport", "2024-09-30", "2024-08-01", "xlsx"), ("drugChecks", "2024-08-30", "2024-08-01", "csv"),
        ("drugChecks", "2024-09-30", "2024-09-01", "csv"), ("drugWorkbook", "2024-09-01", "2024-09-01", "xlsx"),
    ]


def test_latest_missing_and_existing(spark, rows, output):
    files = landing.catalogue(spark, output)
    assert rows(landing.latest_files(files), "source", F.col("as_of").cast("string")) == [
        ("coronerReport", "2024-09-30"), ("drugChecks", "2024-09-30"), ("drugWorkbook", "2024-09-01"),
    ]
    wanted = spark.createDataFrame([("drugChecks",), ("placeReport",), ("ambulance",)], "source string")
    assert rows(landing.missing_sources(files, wanted)) == [("ambulance",), ("placeReport",)]
    assert landing.existing_sources(files, wanted).count() == 2
    with pytest.raises(FileNotFoundError):
        landing.latest_path(files, "placeReport")


def test_latest_csv_has_the_dates_of_its_name(spark, output):
    df = readers.read_latest_csv(spark, output, "drugChecks", SAMPLE_CSV)
    assert df.count() == 2
    first = df.first()
    assert (str(first.as_of), str(first.data_until), first["Spectrometer"]) == ("2024-09-30", "2024-09-01", "Fentanyl, Caffeine")


def test_csv_with_other_columns_fails(spark, tmp_path):
    (tmp_path / "20240101_x.csv").write_text("A,B\n1,2\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "20240101_x.csv"), POPULATION_CSV).collect()


def test_region_map_and_features(spark, rows, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"West": ["Cochin", "Regina"], "South": ["Regina", "Pense", "Pense"]}))
    assert rows(readers.read_region_map(spark, str(tmp_path / "map.json"))) == [
        ("Cochin", "West", 0), ("Pense", "South", 1), ("Regina", "South", 1), ("Regina", "West", 0),
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"properties": {"ENGNAME": "Fraser"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": {"ENGNAME": "North"}}]}))
    (tmp_path / "empty.geojson").write_text("{}")
    assert rows(readers.read_features(spark, str(tmp_path / "*.geojson"))) == [("Fraser",), ("North",)]


def test_records(spark, rows, tmp_path):
    records = [
        {"year_month": "2024-07-01T00:00:00.000", "drug_type": feeds.ALL_SUBSTANCES, "deaths": "9"},
        {"year_month": "2024-06-01T00:00:00.000", "drug_type": feeds.ALL_SUBSTANCES, "deaths": "7"},
        {"year_month": "2024-09-01T00:00:00.000", "drug_type": "Opioids", "deaths": "1"},
    ]
    (tmp_path / "r.json").write_text(json.dumps(records))
    df = readers.read_records(spark, str(tmp_path / "r.json"), "year_month string, drug_type string, deaths string")
    assert str(feeds.fatalities_data_until(df).first()[0]) == "2024-07-01"
    events = feeds.event_records(spark, str(tmp_path / "r.json"), "drug_type string", "ambulance")
    assert {r.source for r in events.collect()} == {"ambulance"}


# Archives ------------------------------------------------------------------------


def zip_file(path, members, compression=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", compression) as zf:
        for name, text in members.items():
            zf.writestr(zipfile.ZipInfo(name, (2025, 6, 24, 10, 0, 0)), text, compress_type=compression)
    return str(path)


INDICATORS = "PRUID,Extra,Region,Source,Substance,Specific_Measure,Disaggregator,Time_Period,Year_Quarter,Unit,Value\n" + "\n".join([
    '59,x,British Columbia,Deaths,Opioids,Overall numbers,,By year,2024,Number,2339',
    '1,x,Canada,Deaths,Opioids,Overall numbers,,By quarter,2024 Q3,Number,"1,500"',
    '1,x,Canada,Deaths,Opioids,Overall numbers,,By quarter,2023 Q4,Number,1400',
    '1,x,Canada,Hospital,Opioids,Overall numbers,,By quarter,2025 Q1,Number,1',
    '11,x,"Prince\nEdward",Deaths,Opioids,Overall numbers,,By year,2025 (Jan to Mar),Number,Suppr.',
])


@pytest.mark.parametrize("compression", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_zipped_indicators(spark, compression, tmp_path):
    path = zip_file(tmp_path / "d.zip", {"data.csv": INDICATORS, "readme.txt": "no"}, compression)
    df = feeds.national_harms(spark, path)
    assert df.columns == [*INDICATOR_CSV.names, "as_of"]
    got = {r.Region: r for r in df.collect()}
    assert str(got["Canada"].as_of) == "2025-06-24"
    assert got["Prince\nEdward"].Value == "Suppr." and got["Prince\nEdward"].Disaggregator is None
    assert str(feeds.harms_data_until(df).first()[0]) == "2024-10-01"


def test_many_members_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_ROWS", 7)
    for a in range(2):
        zip_file(tmp_path / f"{a}.zip", {f"m{m}.csv": "A,B\n" + "\n".join(f"{i},{m}" for i in range(50)) for m in range(3)})
    df = archives.read_zip_csv(spark, str(tmp_path / "*.zip"), ["B", "A"])
    assert df.count() == 300
    assert df.agg(F.sum(F.col("A").cast("int"))).first()[0] == 6 * 1225


def test_zip_member_without_a_column_fails(spark, tmp_path):
    path = zip_file(tmp_path / "d.zip", {"data.csv": "A\n1\n"})
    with pytest.raises(Exception, match="columns missing"):
        archives.read_zip_csv(spark, path, ["A", "B"]).collect()


def test_population_and_offences(spark, rows, tmp_path):
    text = "REF_DATE,GEO,DGUID,Gender,Age group,VALUE\n" + "\n".join([
        "2006,Quebec,x,Total - gender,All ages,1", "2007,Quebec,x,Total - gender,All ages,7",
        "2024,Quebec,x,Men+,All ages,4", "2024,Quebec,x,Total - gender,0 to 4,3", "2024,Quebec,x,Total - gender,All ages,9",
    ])
    path = zip_file(tmp_path / "p.zip", {"17.csv": text})
    assert rows(feeds.population_from_zip(spark, path)) == [("Quebec", 2007, 7), ("Quebec", 2024, 9)]
    crime = "REF_DATE,GEO,Violations,Statistics,VALUE\n2006,NB,Possession [4140],Incidents,1\n2020,NB,Possession [4140],Incidents,12\n2020,NB,Arson [1629],Incidents,3\n"
    path = zip_file(tmp_path / "c.zip", {"35.csv": crime})
    assert rows(feeds.drug_offences_from_zip(spark, path), "geo", "year", "value") == [("NB", 2020, 12.0)]


# Workbooks -----------------------------------------------------------------------


def workbook(path, sheets, ns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"):
    """A small workbook: text as shared strings, the rest as numbers."""
    strings, parts = [], {}
    for n, grid in enumerate(sheets.values(), 1):
        body = ""
        for r, row in enumerate(grid, 1):
            cells = ""
            for c, value in enumerate(row):
                if value is None:
                    continue
                ref = f"{chr(65 + c)}{r}"
                if isinstance(value, str):
                    strings.append(value)
                    cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    cells += f'<c r="{ref}"><v>{value}</v></c>'
            body += f'<row r="{r}">{cells}</row>'
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{links}</Relationships>"
    shared = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{ns}">{shared}</sst>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, text in parts.items():
            zf.writestr(name, text)
    return str(path)


def test_cells_titles_and_headers(spark, rows, tmp_path):
    path = workbook(tmp_path / "b.xlsx", {"Table 1": [
        ["Unnamed: 0", "Deaths by Age", "Unnamed: 2"], ["", "Age", "2024"], ["0", "<19", 3.0], ["1", "20-29", None],
    ]})
    cells = workbooks.read_workbook_cells(spark, path)
    assert rows(workbooks.sheet_titles(cells), "title") == [("Deaths by Age",)]
    headed = workbooks.promote_header(workbooks.drop_columns(cells, 0), header_row=1)
    assert rows(workbooks.cells_to_table(headed, ["Age", "2024"]), "row_no", "Age", "2024") == [(0, "<19", "3"), (1, "20-29", None)]
    full = workbooks.complete_rows(workbooks.drop_columns(cells, 0).filter("row_no > 1"))
    assert rows(full, "value") == [("3",), ("<19",)]


def test_monthly_workbook(spark, rows, tmp_path):
    strict = "http://purl.oclc.org/ooxml/spreadsheetml/main"
    head = [["Title"], [None], ["Note"], ["Year", "Month", "Opioid Confirmed", "Opioid probable", "Stimulant", "Other"]]
    provincial = head + [
        [2018, 1, 10, 0, 3, 2], [None, 2, 11, 1, 4, "*"], [2019, 1, 12, 2, 5, 1], [None, 2, 13, "*", 6, 1],
        [None], ["a note"], ["a note"], ["a note"],
    ]
    units = [
        ["Title"], [None, 2018, None, 2019], [None, 11, 12, 1], ["All", 30, 40, 50], ["Algoma", 10, "*", 20], ["Toronto", 20, 30, 30],
        ["n"], ["n"], ["n"],
    ]
    path = workbook(tmp_path / "on.xlsx", {"Provincial Drug Toxicity": provincial, "PHU Confirmed & Probable": units}, ns=strict)
    by_drug, by_unit = feeds.ontario_workbook(spark, path)
    assert by_drug.count() == 16
    got = {(r.series, r.year, r.month): r for r in by_drug.collect()}
    assert got["opioid confirmed", 2018, 2].value == 11
    assert got["other drug", 2018, 2].is_suppressed and got["other drug", 2018, 2].value is None
    assert rows(by_unit, "unit", "year", "month", "raw_value") == sorted([
        ("All", 2018, 11, "30"), ("All", 2018, 12, "40"), ("All", 2019, 1, "50"), ("Algoma", 2018, 11, "10"),
        ("Algoma", 2018, 12, "*"), ("Algoma", 2019, 1, "20"), ("Toronto", 2018, 11, "20"), ("Toronto", 2018, 12, "30"), ("Toronto", 2019, 1, "30"),
    ], key=repr)


# Grids ---------------------------------------------------------------------------


def aria(header_rows, body):
    row = lambda cells: '<div role="row">' + "".join(f'<div role="{r}"><div>{t}</div></div>' for r, t in cells) + "</div>"
    return '<div role="grid">' + "".join(map(row, header_rows)) + "".join(map(row, body)) + "</div>"


def test_dashboard_grid_with_months(spark, rows):
    head = [("columnheader", "")] + [("columnheader", f"{m}\u00a0") for m in ("Nov", "Dec", "Jan")]
    body = [[("rowheader", "Fraser\u00a0"), ("gridcell", "1"), ("gridcell", "2\u00a0"), ("gridcell", "*")]]
    html = aria([[("columnheader", "Year")], head], body)
    pages = spark.createDataFrame([(1, "Interior Health Authority", "Deaths by Month", html)], "page_id int, selection string, title string, html string")
    out = feeds.dashboard_tables(pages, base_year=2024, header="monthly")
    assert rows(out, "title", "label", "header", "year", "value", "is_suppressed") == sorted([
        ("Interior Health Authority: Deaths by Month", "Fraser", "Nov", 2023, 1.0, False),
        ("Interior Health Authority: Deaths by Month", "Fraser", "Dec", 2023, 2.0, False),
        ("Interior Health Authority: Deaths by Month", "Fraser", "Jan", 2024, None, True),
    ], key=repr)


def test_dashboard_grid_plain_and_yearly(spark, rows):
    plain = aria([[("columnheader", "HA"), ("columnheader", "2023 "), ("columnheader", "2024")]], [[("rowheader", "North"), ("gridcell", "5"), ("gridcell", "6")]])
    two = [("columnheader", "")] + [("columnheader", c) for c in ("Number", "Percent", "Number", "Percent")]
    yearly = aria([[("columnheader", "x")], two], [[("rowheader", "North"), *[("gridcell", str(i)) for i in range(4)]]])
    make = lambda html: spark.createDataFrame([(1, "", "T", html)], "page_id int, selection string, title string, html string")
    assert rows(feeds.dashboard_tables(make(plain), 2024), "title", "year", "value") == [("T", 2023, 5.0), ("T", 2024, 6.0)]
    assert rows(feeds.dashboard_tables(make(yearly), 2024, "yearly"), "header", "year", "value") == sorted(
        [("Number", 2023, 0.0), ("Percent", 2023, 1.0), ("Number", 2024, 2.0), ("Percent", 2024, 3.0)], key=repr
    )


def test_sample_pages(spark, rows):
    cells = "".join(f"<td>{v}</td>" for v in ["2024-03-01", "City", "Interior Health", "S", "Opioid", "Opioid", "Blue", "x &amp; y", "Pos", "Neg", "Fentanyl<br>, Caffeine"])
    html = f"<table><tr><th>Visit Date</th></tr><tr>{cells}</tr></table><table><tr>{cells}</tr></table>"
    out = feeds.samples_from_pages(spark.createDataFrame([(7, html)], "page_id int, html string"))
    assert out.columns == SAMPLE_CSV.names and out.count() == 2
    assert rows(out, "Description", "Spectrometer")[0] == ("x & y", "Fentanyl, Caffeine")


def test_nested_and_broken_grids(spark, rows):
    html = "<ul><li><a>1</a><ul><li><a>inner</a></li></ul></li><li><a>2</a></ul><p>x<a>no</a><table><tr><td>open"
    cells = grids.read_grid_cells(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"))
    assert rows(cells, "grid_no", "row_no", "text") == [(0, 0, "1"), (0, 1, "2"), (1, 0, "inner")]


# Sinks ---------------------------------------------------------------------------


def test_versions_are_replaced_and_pruned(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_version(df, path, "harms", "2024-01-01", "2023-12-01")
    sinks.write_version(df.withColumn("v", F.lit(2)), path, "harms", "2024-02-01", "2023-12-01")
    sinks.write_version(df.withColumn("v", F.lit(3)), path, "harms", "2024-02-01", "2023-12-01")
    sinks.write_version(df.withColumn("v", F.lit(9)), path, "other", "2024-03-01", "2023-12-01")
    assert rows(sinks.latest_version(spark, path, "harms"), "k", "v") == [("a", 3)]
    versions = spark.read.parquet(path).select("source", "as_of", "data_until").distinct()
    assert rows(sinks.retained_versions(versions), "source", F.col("as_of").cast("string")) == [("harms", "2024-02-01"), ("other", "2024-03-01")]


def test_year_partitions_and_workbook(spark, rows, tmp_path):
    path = str(tmp_path / "pop")
    old = spark.createDataFrame([("bc", 2022, 1), ("bc", 2023, 2)], "geo string, year int, population int")
    sinks.replace_partitions(old, path, ["year"])
    new = spark.createDataFrame([("bc", 2023, 5), ("bc", 2024, 6)], "geo string, year int, population int")
    for _ in range(2):
        sinks.replace_partitions(new, path, ["year"])
    assert rows(spark.read.parquet(path), "year", "population") == [(2022, 1), (2023, 5), (2024, 6)]
    sheets = spark.createDataFrame([("Table 1", "x"), ("Table 2", "y")], "sheet string, v string")
    sinks.write_workbook(sheets, str(tmp_path / "book"))
    assert rows(spark.read.parquet(str(tmp_path / "book")).filter("sheet = 'Table 2'"), "v") == [("y",)]


def test_series_documents_round_trip(spark, rows, tmp_path):
    mart = spark.createDataFrame(
        [("heat", g, m, s, y, float(v)) for v, (g, m, s, y) in enumerate(
            (g, m, s, y) for g in ("bc", "ab") for m in ("counts", "rates") for s in ("Male", "Fe\"male") for y in (2023, 2024))],
        "chart string, geo string, metric string, series string, year int, value double",
    )
    lines = V.series_rows(mart, ["chart", "geo", "metric", "series"], "year", "value")
    sources = spark.createDataFrame([("heat", "Coroner", "2024-09-30")], "chart string, name string, last_updated string")
    documents = V.series_documents(lines, sources)
    assert documents.count() == 2
    one = json.loads(documents.filter("geo = 'bc'").first().value)
    assert one["data"]["counts"]["Male"] == {"x": ["2023", "2024"], "y": [0.0, 1.0]}
    assert one["data_source"] == {"name": "Coroner", "last_updated": "2024-09-30"}
    path = str(tmp_path / "docs")
    sinks.write_documents(documents, path)
    back = readers.series_points(readers.read_series_documents(spark, path))
    assert rows(back, "chart", "geo", "metric", "series", F.col("x").cast("int"), "y") == rows(mart)
    single = json.loads(V.series_lines(lines).filter("geo = 'ab'").first().value)
    assert set(single) == {"chart", "geo", "metric", "series", "x", "y"}


def test_observations_store(spark, tmp_path):
    df = spark.createDataFrame([("s", "2024-01-01", "bc", 1.0)], "source string, as_of string, geo string, value double")
    for _ in range(2):
        sinks.write_observations(df, str(tmp_path / "obs"))
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 1


# Stream --------------------------------------------------------------------------


def test_feed_stream_adds_only_new_rows(spark, rows, tmp_path):
    landing_dir, store = tmp_path / "landing", str(tmp_path / "store")
    landing_dir.mkdir()
    schema = "`Visit Date` string, Category string"
    schema = spark.createDataFrame([], schema).schema
    head = "Visit Date,Category\n"

    def land(day, *lines):
        (landing_dir / f"{day}_drugChecks.csv").write_text(head + "\n".join(lines) + "\n")

    def load():
        load_feed(spark, str(landing_dir), schema, store, "Visit Date", checkpoint_root(spark, str(tmp_path / "c")) + f"/{tmp_path.name}").awaitTermination()
        return rows(spark.read.parquet(store), "Visit Date", "Category")

    land("20240101", "2024-01-01,a", "2024-01-01,a", "2023-12-31,b")
    land("20240102", "2024-01-02,c", "2024-01-01,a", "2024-01-01,a")
    first = load()
    assert first == [("2023-12-31", "b"), ("2024-01-01", "a"), ("2024-01-01", "a"), ("2024-01-02", "c")]
    land("20240103", "2024-01-03,d", "2024-01-02,c", "2024-01-02,c")
    assert load() == sorted(first + [("2024-01-02", "c"), ("2024-01-03", "d")])
    assert len(load()) == 6


def test_records_of_both_layouts(spark, tmp_path, rows):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n\n{"a": 3}\n')
    (tmp_path / "array.json").write_text('[\n  {"a": 4},\n  {"a":\n 5}\n]')
    (tmp_path / "one.json").write_text('[{"a": 6}, {"a": 7}]')
    assert rows(readers.read_records(spark, str(tmp_path), "a int")) == [(n,) for n in range(1, 8)]


def test_documents_of_other_regions_stay(spark, tmp_path, rows):
    for geo in ("BC", "AB", "BC"):
        sinks.write_documents(spark.createDataFrame([("deaths", geo, f"{{{geo}}}")], "chart string, geo string, value string"), str(tmp_path))
    assert rows(spark.read.text(str(tmp_path)), "chart", "geo", "value") == [("deaths", "AB", "{AB}"), ("deaths", "BC", "{BC}")]


def test_latest_version_of_two_on_one_day(spark, tmp_path, rows):
    df = spark.createDataFrame([(1,)], "n int")
    for until in ("20240101", "20240201"):
        sinks.write_version(df.withColumn("n", F.lit(int(until))), str(tmp_path), "s", "20240301", until)
    assert rows(sinks.latest_version(spark, str(tmp_path), "s"), "n") == [(20240201,)]


def test_unknown_compression_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_BZIP2) as zf:
        zf.writestr("m.csv", "a\n1\n")
    with pytest.raises(Exception, match="packed by a method"):
        archives.zip_members(spark, str(tmp_path / "*.zip"), ".csv").collect()
