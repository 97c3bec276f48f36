"""Text reports: titled tables printed as lines.

A report is one row holding its text. All order-dependent rules (where a table starts and ends, which
year or sex a line belongs to, lines broken in two) are written as splits of that text into nested
blocks, so they need neither a shuffle nor a window, and the only explode is the final one to lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions.text import (
    capital_tokens, contains_any, label_part, no_blanks, squeeze_blanks, value_parts,
)

# Words that show a title is only mentioned in running prose, and footnote openings.
PROSE_WORDS = ("updated", "statistics", "shown")
FOOTNOTES = ("Please note", "This current table includes")
MANNERS = ("Accident", "Suicide", "Homicide", "Undetermined")

# The tables of the provincial coroner report, whether they are read, and their rule.
REPORT_TABLES = (
    ("Confirmed & Suspected Drug Toxicity Deaths by Manner of Death", True, "confirmed_suspected"),
    ("Breakdown of Opioid Drugs Identified in Confirmed Drug Toxicity Deaths by Manner of Death", True, "manner_breakdown"),
    ("Breakdown of Benzodiazepine Drugs Identified in Confirmed Drug Toxicity Deaths by Manner of Death", False, "manner_breakdown"),
    ("Confirmed Drug Toxicity Deaths Involving Opioid Drugs by Manner of Death, Sex and Race", False, "sex_race"),
    ("Confirmed Drug Toxicity Deaths Involving Opioid Drugs by Manner of Death, Sex and Age Group", False, "sex_age"),
    ("Confirmed Drug Toxicity Deaths Involving Fentanyl by Manner of Death, Sex and Race", False, "sex_race"),
    ("Confirmed Drug Toxicity Deaths Involving Fentanyl by Manner of Death, Sex and Age Group", False, "sex_age"),
    ("Confirmed Drug Toxicity Deaths Involving Benzodiazepines", False, "benzodiazepines"),
    ("Confirmed Drug Toxicity Deaths by Place of Death", True, "place"),
    ("Number of Confirmed Deaths Where Methamphetamine Toxicity was Part of the Cause of Death", False, "sole_or_combined"),
    ("Breakdown of Fentanyl (F), Carfentanyl (C), Acetylfentanyl (A), Furanylfentanyl (FF), Para-fluorofentanyl (PF) & Methylfentanyl (MF) Identified in Confirmed Drug Toxicity Deaths by Place of Death", False, "fentanyl_place"),
    ("Number of Confirmed Deaths Where Xylazine Toxicity was Part of the Cause of Death", False, "sole_or_combined"),
)


def report_lines(reports: DataFrame, text: str = "text") -> DataFrame:
    """Pages to ordered lines.

    Outer explodes, here and below: a plain one is preceded by a test for emptiness that evaluates the
    exploded expression a second time.
    """
    rest = [c for c in reports.columns if c != text]
    lines = reports.select(*rest, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    return lines.filter("line_no is not null")


def blocks(text: Column, starts: str) -> Column:
    """Cut a text in front of every line that begins with the pattern."""
    return F.split(text, rf"(?m)\n(?=(?:{starts}))")


def enabled_titles(tables: Sequence[tuple] = REPORT_TABLES) -> dict[str, str]:
    return {title: rule for title, enabled, rule in tables if enabled}


def _spaced(title: str) -> str:
    """Pattern for a title whatever blanks the text extraction put between its letters."""
    letters = [c if c.isalnum() else "\\" + c for c in lookup_title(title)]
    return " *".join(letters)


def lookup_title(title: str) -> str:
    return title.lower().replace(" ", "")


def report_tables(
    reports: DataFrame, titles: Mapping[str, str], text: str = "text", leftovers: str | None = None
) -> DataFrame:
    """Titled tables: ``(…, table_no, title, rule, body)``.

    A table runs from the first title line behind a blank line to the next blank line; title lines
    inside a running table are data. ``leftovers`` names lines (the rest of a title, say) which,
    with the blank line behind them, do not end the table.
    """
    prose = "|".join(" *".join(w) for w in PROSE_WORDS)
    any_title = "|".join(_spaced(t) for t in titles)
    # the title line and all that follows; a match never looks beyond its line for the title
    from_title = rf"(?i)(?:^|\n)(?=[^\n]*?(?:{any_title}))(?![^\n]*(?:{prose}))[\s\S]*$"
    keys = [lookup_title(t) for t in titles]

    def found(paragraph: Column) -> Column:
        # most paragraphs have no title at all: a plain substring test spares them the pattern
        possible = contains_any(F.lower(no_blanks(paragraph)), keys)
        return F.when(possible, F.ltrim(F.regexp_extract(paragraph, from_title, 0), F.lit("\n"))).otherwise("")

    source = F.concat(F.lit("\n"), F.col(text))
    if leftovers is not None:
        source = F.regexp_replace(source, rf"\n(?:{leftovers})[^\n]*\n {{0,3}}(?=\n)", "")
    paragraphs = F.split(source, r"\n(?: {0,3}(?:\n|\z))+")
    rest = [c for c in reports.columns if c != text]
    tables = (
        reports.select(*rest, F.posexplode_outer(F.transform(paragraphs, found)).alias("table_no", "_table"))
        .filter("_table <> ''")
        .withColumn("_title", F.substring_index("_table", "\n", 1))
        .withColumn("body", F.substring(F.col("_table"), F.length("_title") + 2, F.length("_table")))
    )
    key = F.lower(no_blanks(F.col("_title")))
    name, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for title, its_rule in reversed(list(titles.items())):
        hit = key.contains(lookup_title(title))
        name = F.when(hit, F.lit(title)).otherwise(name)
        rule = F.when(hit, F.lit(its_rule)).otherwise(rule)
    return tables.select(*rest, "table_no", name.alias("title"), rule.alias("rule"), "body")


def _lines(body: Column) -> Column:
    """Squeezed lines of a table body without empty lines and footnotes."""
    squeezed = F.transform(F.split(body, "\n"), squeeze_blanks)
    return F.filter(
        squeezed,
        lambda line: (line != "") & ~line.rlike("|".join(FOOTNOTES)),
    )


def _keys(tables: DataFrame) -> list[str]:
    return [c for c in tables.columns if c not in ("rule", "body")]


def _exploded(tables: DataFrame, array: Column, names: tuple[str, str], **once: Column) -> DataFrame:
    """Explode ``array``, with the columns ``once`` beside it.

    Those are computed in a step of their own: written next to the explode, Spark would compute them
    again for every line, which makes a long table quadratic.
    """
    keys = _keys(tables)
    prepared = tables.select(*keys, *[c.alias(n) for n, c in once.items()], array.alias("_array"))
    return prepared.select(*keys, *once, F.posexplode_outer("_array").alias(*names)).filter(F.col(names[0]).isNotNull())


def _with_header(tables: DataFrame, header: Column, rows: Column) -> DataFrame:
    """Lines with the years of their table's header line: one row per line."""
    return _exploded(tables, rows, ("row_no", "line"), _years=header)


def _year_values(lines: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Values of a line to one row per header year; a printed total column is left out."""
    return lines.select(
        *keep, F.inline(F.arrays_zip(F.col("_years").alias("year"), F.col("_values").alias("raw_value")))
    ).filter("year is not null and raw_value is not null").withColumn("year", F.col("year").try_cast("int")).filter("year is not null")


def place_of_death(tables: DataFrame) -> DataFrame:
    """Location lines below a line of years: ``(…, location, year, raw_value)``."""
    keys = _keys(tables)
    lines = _lines(F.col("body"))
    years = F.split(F.get(F.filter(lines, lambda x: x.rlike(r"^\d")), F.lit(0)), " ")
    rows = F.filter(lines, lambda x: ~x.rlike(r"^\d"))
    out = _with_header(tables, years, rows).withColumns(
        {"location": label_part(F.col("line")), "_values": value_parts(F.col("line"))}
    )
    return _year_values(out, [*keys, "row_no", "location"])


def confirmed_suspected(tables: DataFrame) -> DataFrame:
    """Manner lines below a line of years. Confirmed manners get the suffix ``-Confirmed``; the block
    labels "Confirmed Cases" and "Suspected Cases" in front of a line are dropped."""
    keys = _keys(tables)
    lines = _lines(F.col("body"))
    years = F.split(F.get(F.filter(lines, lambda x: x.rlike(r"^\d")), F.lit(0)), " ")
    rows = F.filter(lines, lambda x: ~x.rlike(r"^\d"))
    raw = F.col("line")
    bare = F.trim(F.regexp_replace(raw, r"(?:Confirmed|Suspected) Cases", ""))
    confirmed = raw.rlike("^(?:" + "|".join(MANNERS) + ")") | raw.startswith("Confirmed Cases")
    label = F.trim(F.regexp_extract(bare, r"^([^0-9-]*)", 1))
    out = _with_header(tables, years, rows).withColumns({
        "manner": F.when(confirmed, F.concat(F.substring_index(label, " ", 1), F.lit("-Confirmed"))).otherwise(label),
        "_values": value_parts(bare),
    })
    return _year_values(out, [*keys, "row_no", "manner"])


def manner_breakdown(tables: DataFrame) -> DataFrame:
    """Drug counts per year and manner. The header lines name the drugs in joined capitals; a year is
    printed once and holds for the manner lines below it."""
    keys = _keys(tables)
    lines = _lines(F.col("body"))
    is_row = "|".join(MANNERS)
    drugs = capital_tokens(F.array_join(F.filter(lines, lambda x: ~x.rlike(is_row)), " "))
    rows = F.array_join(F.filter(lines, lambda x: x.rlike(is_row)), "\n")
    years = _exploded(tables, blocks(rows, r"\d"), ("_year_no", "_block"), _drugs=drugs)
    out = (
        years.filter(F.col("_block") != "")
        .select(*keys, "_drugs", F.substring("_block", 1, 4).try_cast("int").alias("year"), F.split("_block", "\n").alias("_lines"))
        .select(*keys, "_drugs", "year", F.explode("_lines").alias("line"))
        .withColumn("_rest", F.regexp_replace("line", r"^\d{4} ", ""))
        .withColumn("manner", F.get(F.split("_rest", " "), F.lit(0)))
        .withColumn("_values", F.slice(F.split("_rest", " "), 2, 2147483647 // 2))
    )
    return out.select(
        *keys, "year", "manner",
        F.inline(F.arrays_zip(F.col("_drugs").alias("drug"), F.col("_values").alias("raw_value"))),
    ).filter("drug is not null and raw_value is not null")


def _manner_sex_blocks(tables: DataFrame, body: Column, years: Column) -> DataFrame:
    """Lines with the manner and the sex printed above them, from two nested splits."""
    keys = _keys(tables)
    manner_start = "|".join(MANNERS)
    sex_start = "Male|Female"
    by_manner = _exploded(tables, blocks(body, manner_start), ("_m", "_manner_block"), _years=years).filter(
        F.col("_manner_block").rlike(f"^(?:{manner_start})")
    )
    by_sex = by_manner.select(
        *keys, "_years", "_m", F.substring_index("_manner_block", " ", 1).alias("manner"),
        # the manner line carries the first sex
        blocks(F.regexp_replace("_manner_block", r"^\S+ ", ""), sex_start).alias("_sex_blocks"),
    ).select(*keys, "_years", "_m", "manner", F.posexplode("_sex_blocks").alias("_s", "_sex_block"))
    return by_sex.select(
        *keys, "_years", "_m", "_s", "manner",
        F.substring_index(F.substring_index("_sex_block", "\n", 1), " ", 1).alias("sex"),
        F.split("_sex_block", "\n").alias("_block_lines"),
    )


def _headed_years(lines: Column) -> Column:
    return F.split(F.get(F.filter(lines, lambda x: x.rlike(r"^\d{4}(?: |$)")), F.lit(0)), " ")


def sex_race(tables: DataFrame) -> DataFrame:
    """Race lines below manner and sex lines. A line ending in ``&`` goes on in the next one."""
    keys = _keys(tables)
    lines = F.transform(_lines(F.col("body")), lambda x: F.replace(x, F.lit("non -s"), F.lit("nonS")))
    years = _headed_years(lines)
    data = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\d|^Race")), "\n")
    joined = F.regexp_replace(data, r"&\n", "& ")
    out = _manner_sex_blocks(tables, joined, years).select(
        *keys, "_years", "_m", "_s", "manner", "sex",
        F.posexplode(F.slice("_block_lines", 2, 2147483647 // 2)).alias("row_no", "line"),
    ).withColumns({
        "race": label_part(F.replace(F.col("line"), F.lit("non-s"), F.lit("nonS"))),
        "_values": value_parts(F.replace(F.col("line"), F.lit("non-s"), F.lit("nonS"))),
    })
    return _year_values(out, [*keys, "manner", "sex", "row_no", "race"])


def sex_age(tables: DataFrame) -> DataFrame:
    """Age-group lines of each manner and sex. The manner line carries sex, age group and values; a
    very short line is the start of a broken one; ranges are printed with varying dashes."""
    keys = _keys(tables)
    en_dash = "–"
    lines = _lines(F.col("body"))
    header = F.get(F.filter(lines, lambda x: x.rlike(r"^\d{4}(?: \d{4})*$")), F.lit(0))
    years = F.split(header, " ")
    # the rest of a title may be printed as a span of years
    data = F.array_join(F.filter(F.array_remove(lines, header), lambda x: ~x.rlike(rf"^\d{{4}} ?[{en_dash}-]")), "\n")
    # the second line is consumed with the first, so a short second line does not take a third
    joined = F.regexp_replace(data, r"(?m)^([0-9][^\n]{0,8})\n([^\n]*)", "$1 $2")
    # only the age range in front; a lone dash further on is a printed "none"
    ranges = rf"(?m)^(?![^\n]*Total)((?:[A-Za-z&]+ )*)(\d+) ?[{en_dash}-] ?(\d+)(?= |$)"
    tidy = F.regexp_replace(F.regexp_replace(joined, ranges, "$1$2-$3"), r" \+", "+")
    totals = F.regexp_replace(tidy, r"(?m)^Total ", "Male&Female Total ")
    blocked = _manner_sex_blocks(tables, totals, years)
    first = F.regexp_replace(F.get("_block_lines", F.lit(0)), r"^\S+ ", "")
    out = blocked.select(
        *keys, "_years", "manner", "sex",
        F.posexplode(F.concat(F.array(first), F.slice("_block_lines", 2, 2147483647 // 2))).alias("row_no", "line"),
    ).withColumns({
        "age_group": F.substring_index("line", " ", 1),
        "_values": F.slice(F.split("line", " "), 2, 2147483647 // 2),
    })
    return _year_values(out, [*keys, "manner", "sex", "row_no", "age_group"])


def benzodiazepines(tables: DataFrame) -> DataFrame:
    """Same layout as :func:`sex_race`, printed under a shortened title."""
    full = "Confirmed Drug Toxicity Deaths Involving Benzodiazepines by Manner of Death, Sex and Race"
    return sex_race(tables).withColumn("title", F.lit(full))


def fentanyl_place(tables: DataFrame, first_year: Column | int = 2016) -> DataFrame:
    """Analogue counts per place. The columns are analogue letters; every ``F`` opens the next year."""
    keys = _keys(tables)
    lines = _lines(F.col("body"))
    drugs = F.split(F.get(F.filter(lines, lambda x: x.startswith("F F C")), F.lit(0)), " ")
    rows = F.filter(lines, lambda x: ~x.rlike(r"^\d|^F F C"))
    values = _exploded(tables, rows, ("row_no", "line"), _drugs=drugs).select(
        *keys, "row_no", "_drugs", label_part(F.col("line")).alias("location"), value_parts(F.col("line")).alias("_values")
    ).select(*keys, "row_no", "_drugs", "location", F.posexplode("_values").alias("_i", "raw_value"))
    # the year of column i is the number of F's up to and including it
    opened = F.size(F.filter(F.slice("_drugs", F.lit(1), F.col("_i") + 1), lambda o: o == "F"))
    return values.select(
        *keys, "row_no", "location", (F.lit(first_year) - 1 + opened).alias("year"),
        F.get("_drugs", F.col("_i")).alias("drug"), "raw_value",
    ).filter("drug is not null")


def sole_or_combined(tables: DataFrame) -> DataFrame:
    """Year lines with three counts: sole cause, combined cause, total."""
    keys = _keys(tables)
    rows = F.filter(_lines(F.col("body")), lambda x: x.rlike(r"^\d{4}( (\d+|-+))+$"))
    parts = F.split("line", " ")
    return tables.select(*keys, F.posexplode(rows).alias("row_no", "line")).select(
        *keys, F.get(parts, F.lit(0)).cast("int").alias("year"),
        F.inline(F.arrays_zip(
            F.array(F.lit("sole cause"), F.lit("combined cause"), F.lit("total")).alias("series"),
            F.slice(parts, 2, 3).alias("raw_value"),
        )),
    ).filter("raw_value is not null")


RULES = {
    "confirmed_suspected": confirmed_suspected,
    "manner_breakdown": manner_breakdown,
    "sex_race": sex_race,
    "sex_age": sex_age,
    "benzodiazepines": benzodiazepines,
    "place": place_of_death,
    "fentanyl_place": fentanyl_place,
    "sole_or_combined": sole_or_combined,
}


def read_tables(reports: DataFrame, rule: str, tables: Sequence[tuple] = REPORT_TABLES, **options) -> DataFrame:
    """All tables of one rule, continued tables included: pages that repeat a title add rows."""
    titles = {t: r for t, _, r in tables if r == rule}
    return RULES[rule](report_tables(reports, titles, **options))
