"""Report and dashboard rules over texts printed from the given tables.

Each query prints counts the way a publisher does (one report per brand, one dashboard page per
segment) and reads them back with the rule, so the result has to equal the plain counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.operators import measures as M, reshape as R
from tallymark.plans import feeds, harm_marts, standins
from tallymark.plans.registry import query, table
from tallymark.plans.settle import settled
from tallymark.sources import report_scan, reports

TITLE = {rule: title for title, _, rule in reversed(reports.REPORT_TABLES)}

BRAND_SQL = """samples as (
  select p_brand as brand, year(l_shipdate)::integer as year, p_type, l_returnflag, l_linestatus, (p_size // 10 * 10)::integer as age
  from lineitem join part on l_partkey = p_partkey),
axis as (select distinct year from samples),
brands as (select distinct brand from samples)"""

PRINTED_SQL = "case when count(s.year) = 0 then '-' else count(s.year)::varchar end"
MANNER_SQL = "case {c} when 'A' then 'Accident' when 'N' then 'Suicide' else 'Homicide' end"


def _brand_counts(spark: SparkSession, d: str, *keys: Column, reused: bool = True) -> DataFrame:
    """Samples per brand, year and the given keys. One row per part and year goes through the join."""
    lines = table(spark, d, "lineitem").select("l_partkey", standins.year("l_shipdate"), "l_returnflag", "l_linestatus")
    facts = M.tally(lines, ["l_partkey", "year", "l_returnflag", "l_linestatus"])
    parts = table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), "p_type", (F.floor(F.col("p_size") / 10) * 10).cast("int").alias("age")
    )
    joined = facts.join(parts, facts.l_partkey == parts.p_partkey)
    counts = M.tally(joined, ["brand", "year", *keys], "n")
    return settled(counts) if reused else counts


def _manner(flag: str = "l_returnflag") -> Column:
    return F.when(F.col(flag) == "A", "Accident").when(F.col(flag) == "N", "Suicide").otherwise("Homicide")


def _value_lines(counts: DataFrame, keys: list[str], axis: Column) -> DataFrame:
    """``values``: the counts of a line, one per year of the axis, none printed as a dash."""
    filled = R.fill_periods(counts, keys, "year", ["n"], axis)
    printed = F.when(F.col("n") == 0, "-").otherwise(F.col("n").cast("string")).alias("text")
    cells = F.sort_array(F.collect_list(F.struct("year", printed)))
    return filled.groupBy(*keys).agg(F.array_join(F.transform(cells, lambda c: c["text"]), " ").alias("values"))


def _paragraphs(lines: DataFrame, keys: list[str], order: list[str], line: Column, head: Column) -> DataFrame:
    """Lines (a few per category) joined to one text per group, in the given order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    body = F.array_join(F.transform(parts, lambda p: p["line"]), "\n")
    return lines.groupBy(*keys).agg(F.concat(head, body).alias("line"))


def _line_rows(texts: DataFrame) -> DataFrame:
    return reports.report_lines(texts).withColumnRenamed("brand", "report")


def _report(df: DataFrame, rule: str, axis: Column | None) -> DataFrame:
    years = F.lit("") if axis is None else F.concat(F.array_join(axis, " "), F.lit("\n"))
    text = F.concat(F.lit("Report\n\n" + TITLE[rule] + "\n"), years, F.col("line"), F.lit("\n\nEnd of report"))
    return df.select("brand", text.alias("text"))


@query(f"""with {BRAND_SQL}
select b.brand, t.p_type as location, a.year, {PRINTED_SQL} as raw_value
from (select distinct brand, p_type from samples) t join brands b using (brand) cross join axis a
left join samples s on s.brand = b.brand and s.p_type = t.p_type and s.year = a.year
group by b.brand, t.p_type, a.year""")
def report_place_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = _brand_counts(spark, d, F.col("p_type"))
    axis = R.shared_axis(counts, "year")
    lines = _value_lines(counts, ["brand", "p_type"], axis)
    printed = F.concat(F.substring("p_type", 1, 2), F.lit(" "), F.expr("substring(p_type, 3)"), F.lit("  "), F.col("values"))
    texts = _report(_paragraphs(lines, ["brand"], ["p_type"], printed, F.lit("")), "place", axis)
    return reports.read_tables(texts, "place").select("brand", "location", "year", "raw_value")


@query(f"""with {BRAND_SQL},
m as (select *, case p_type when 'PROMO' then 'Accident-Confirmed' when 'SMALL' then 'Homicide-Confirmed' else 'Suspected' end as manner
      from samples)
select t.brand, t.manner, a.year, {PRINTED_SQL} as raw_value
from (select distinct brand, manner from m) t cross join axis a
left join m s on s.brand = t.brand and s.manner = t.manner and s.year = a.year
group by t.brand, t.manner, a.year""")
def report_confirmed_counts(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("p_type") == "PROMO", "Accident ").when(F.col("p_type") == "SMALL", "Confirmed Cases Homicide ").otherwise("Suspected Cases Suspected ")
    counts = _brand_counts(spark, d, label.alias("label"))
    axis = R.shared_axis(counts, "year")
    lines = _value_lines(counts, ["brand", "label"], axis)
    texts = _report(_paragraphs(lines, ["brand"], ["label"], F.concat("label", "values"), F.lit("")), "confirmed_suspected", axis)
    return reports.read_tables(texts, "confirmed_suspected").select("brand", "manner", "year", "raw_value")


DRUG_SQL = f"""with {BRAND_SQL},
g as (select distinct brand, year, l_returnflag from samples), t as (select distinct p_type from samples)
select g.brand, g.year, {MANNER_SQL.format(c='g.l_returnflag')} as manner,
       upper(left(t.p_type, 1)) || lower(substr(t.p_type, 2)) as drug, {PRINTED_SQL} as raw_value
from g cross join t left join samples s on s.brand = g.brand and s.year = g.year and s.l_returnflag = g.l_returnflag and s.p_type = t.p_type
group by g.brand, g.year, g.l_returnflag, t.p_type"""


def _drug_reports(spark: SparkSession, d: str) -> DataFrame:
    """Drugs run across in joined capitals; a year is printed on the first of its manner lines only."""
    counts = _brand_counts(spark, d, F.col("p_type"), F.col("l_returnflag"))
    drugs = counts.agg(F.sort_array(F.collect_set(F.initcap("p_type")))).scalar()
    filled = R.fill_periods(
        counts.withColumn("drug", F.initcap("p_type")), ["brand", "year", "l_returnflag"], "drug", ["n"], drugs
    )
    printed = F.when(F.col("n") == 0, "-").otherwise(F.col("n").cast("string")).alias("text")
    cells = F.sort_array(F.collect_list(F.struct("drug", printed)))
    lines = filled.groupBy("brand", "year", "l_returnflag").agg(F.array_join(F.transform(cells, lambda c: c["text"]), " ").alias("values"))
    year_text = F.concat(F.first("year").cast("string"), F.lit(" "))
    by_year = _paragraphs(lines, ["brand", "year"], ["l_returnflag"], F.concat(_manner(), F.lit(" "), "values"), year_text)
    head = F.concat(F.array_join(F.slice(drugs, 1, 2), ""), F.lit("\n"), F.array_join(F.slice(drugs, 3, F.size(drugs)), " "), F.lit("\n"))
    return _report(_paragraphs(by_year, ["brand"], ["year"], F.col("line"), head), "manner_breakdown", None)


@query(DRUG_SQL)
def report_drug_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.read_tables(_drug_reports(spark, d), "manner_breakdown").select("brand", "year", "manner", "drug", "raw_value")


@query(DRUG_SQL)
def report_drug_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same reports as rows of lines, dealt in blocks of a few lines."""
    found = report_scan.manner_breakdown(_line_rows(_drug_reports(spark, d)), {TITLE["manner_breakdown"]: ""}, block_lines=16)
    return found.withColumnRenamed("report", "brand").select("brand", "year", "manner", "drug", "raw_value")


RACE_SQL = f"""with {BRAND_SQL},
t as (select distinct brand, l_returnflag, l_linestatus, p_type from samples)
select t.brand, {MANNER_SQL.format(c='t.l_returnflag')} as manner, case t.l_linestatus when 'F' then 'Female' else 'Male' end as sex,
       case t.p_type when 'PROMO' then 'PROMO&Other' else t.p_type end as race, a.year, {PRINTED_SQL} as raw_value
from t cross join axis a left join samples s
  on s.brand = t.brand and s.l_returnflag = t.l_returnflag and s.l_linestatus = t.l_linestatus and s.p_type = t.p_type and s.year = a.year
group by t.brand, t.l_returnflag, t.l_linestatus, t.p_type, a.year"""


def _race_reports(spark: SparkSession, d: str) -> DataFrame:
    """Race lines below manner and sex lines, one of them broken in two."""
    counts = _brand_counts(spark, d, F.col("l_returnflag"), F.col("l_linestatus"), F.col("p_type"))
    axis = R.shared_axis(counts, "year")
    lines = _value_lines(counts, ["brand", "l_returnflag", "l_linestatus", "p_type"], axis)
    race = F.when(F.col("p_type") == "PROMO", "PROMO &\nOther").otherwise(F.col("p_type"))
    sex = F.when(F.first("l_linestatus") == "F", "Female\n").otherwise("Male\n")
    by_sex = _paragraphs(lines, ["brand", "l_returnflag", "l_linestatus"], ["p_type"], F.concat(race, F.lit(" "), "values"), sex)
    by_manner = _paragraphs(by_sex, ["brand", "l_returnflag"], ["l_linestatus"], F.col("line"), F.concat(F.first(_manner()), F.lit(" ")))
    return _report(_paragraphs(by_manner, ["brand"], ["l_returnflag"], F.col("line"), F.lit("")), "sex_race", axis)


@query(RACE_SQL)
def report_race_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.read_tables(_race_reports(spark, d), "sex_race").select("brand", "manner", "sex", "race", "year", "raw_value")


@query(RACE_SQL)
def report_race_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same reports as rows of lines, dealt in blocks of a few lines."""
    found = report_scan.sex_race(_line_rows(_race_reports(spark, d)), {TITLE["sex_race"]: ""}, block_lines=16)
    return found.withColumnRenamed("report", "brand").select("brand", "manner", "sex", "race", "year", "raw_value")


@query(f"""with {BRAND_SQL},
t as (select distinct brand, l_returnflag, l_linestatus, age from samples)
select t.brand, {MANNER_SQL.format(c='t.l_returnflag')} as manner, case t.l_linestatus when 'F' then 'Female' else 'Male' end as sex,
       case when t.age = 50 then '50+' else t.age || '-' || (t.age + 9) end as age_group, a.year, {PRINTED_SQL} as raw_value
from t cross join axis a left join samples s
  on s.brand = t.brand and s.l_returnflag = t.l_returnflag and s.l_linestatus = t.l_linestatus and s.age = t.age and s.year = a.year
group by t.brand, t.l_returnflag, t.l_linestatus, t.age, a.year""")
def report_age_counts(spark: SparkSession, d: str) -> DataFrame:
    """Age lines: the first one of a sex carries its name, open ranges break after the label."""
    counts = _brand_counts(spark, d, F.col("l_returnflag"), F.col("l_linestatus"), F.col("age"))
    axis = R.shared_axis(counts, "year")
    lines = _value_lines(counts, ["brand", "l_returnflag", "l_linestatus", "age"], axis)
    # an open range that opens its group stays on one line, as a broken line has to start with a digit
    opens = F.when(F.col("age") == 50, "50 +\n").otherwise(F.concat(F.col("age"), F.lit(" – "), F.col("age") + 9, F.lit(" ")))
    sex = F.when(F.first("l_linestatus") == "F", "Female ").otherwise("Male ")
    by_sex = _paragraphs(lines, ["brand", "l_returnflag", "l_linestatus"], ["age"], F.concat(opens, "values"), sex)
    tidy = by_sex.withColumn("line", F.regexp_replace("line", r"^(\w+ 50 \+)\n", "$1 "))
    by_manner = _paragraphs(tidy, ["brand", "l_returnflag"], ["l_linestatus"], F.col("line"), F.concat(F.first(_manner()), F.lit(" ")))
    texts = _report(_paragraphs(by_manner, ["brand"], ["l_returnflag"], F.col("line"), F.lit("")), "sex_age", axis)
    return reports.read_tables(texts, "sex_age").select("brand", "manner", "sex", "age_group", "year", "raw_value")


@query(f"""with {BRAND_SQL},
letters as (select year, letter from axis cross join (select unnest(['F', 'C']) as letter)
            where not (letter = 'C' and year = (select min(year) from axis))),
t as (select distinct brand, p_type from samples)
select t.brand, t.p_type as location, l.year, l.letter as drug, {PRINTED_SQL} as raw_value
from t cross join letters l left join samples s
  on s.brand = t.brand and s.p_type = t.p_type and s.year = l.year and (s.l_returnflag = 'A') = (l.letter = 'F')
group by t.brand, t.p_type, l.year, l.letter""")
def report_analogue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Analogue letters run across; every F opens the next year, the first year has nothing but F."""
    counts = _brand_counts(spark, d, F.col("p_type"), F.col("l_returnflag"))
    first = counts.agg(F.min("year")).scalar()
    last = counts.agg(F.max("year")).scalar()
    letter = F.when(F.col("l_returnflag") == "A", F.lit(0)).otherwise(F.lit(1))
    # column 2 * years since the first + letter; the C of the first year is not printed
    placed = counts.withColumn("col_no", (F.col("year") - first) * 2 + letter)
    axis = F.array_remove(F.sequence(F.lit(0), (last - first) * 2 + 1), 1)
    every = R.fill_periods(
        placed.withColumn("n", F.when(F.col("col_no").isNull(), 0).otherwise(F.col("n")))
        .groupBy("brand", "p_type", F.coalesce("col_no", F.lit(-1)).alias("col_no")).agg(F.sum("n").alias("n")),
        ["brand", "p_type"], "col_no", ["n"], axis,
    )
    printed = F.when(F.col("n") == 0, "-").otherwise(F.col("n").cast("string")).alias("text")
    cells = F.sort_array(F.collect_list(F.struct("col_no", printed)))
    lines = every.groupBy("brand", "p_type").agg(F.array_join(F.transform(cells, lambda c: c["text"]), " ").alias("values"))
    letters = F.concat(F.lit("F"), F.repeat(F.lit(" F C"), last - first))
    head = F.concat(F.array_join(F.sequence(first, last), " "), F.lit("\n"), letters, F.lit("\n"))
    texts = _report(_paragraphs(lines, ["brand"], ["p_type"], F.concat("p_type", F.lit(" "), "values"), head), "fentanyl_place", None)
    found = reports.report_tables(texts, {TITLE["fentanyl_place"]: "fentanyl_place"})
    return reports.fentanyl_place(found, first).select("brand", "location", "year", "drug", "raw_value")


@query(f"""with {BRAND_SQL},
c as (select brand, year, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as b, count(*) as t from samples group by all)
select brand, year, 'sole cause' as series, a::varchar as raw_value from c
union all select brand, year, 'combined cause', b::varchar from c union all select brand, year, 'total', t::varchar from c""")
def report_cause_counts(spark: SparkSession, d: str) -> DataFrame:
    """Year lines with three counts, behind the rest of a title and a blank line."""
    counts = _brand_counts(spark, d, F.col("l_returnflag"), reused=False).groupBy("brand", "year").agg(
        *[F.sum(F.when(F.col("l_returnflag") == flag, F.col("n")).otherwise(0)).alias(flag) for flag in "AN"], F.sum("n").alias("all")
    )
    line = F.concat_ws(" ", "year", "A", "N", "all")
    span = counts.agg(F.concat_ws(" – ", F.min("year"), F.max("year"))).scalar()
    head = F.concat(span, F.lit("\n\nYear Sole Combined Total\n"))
    texts = _report(_paragraphs(counts, ["brand"], ["year"], line, head), "sole_or_combined", None)
    return reports.read_tables(texts, "sole_or_combined", leftovers=r"\d{4} –").select("brand", "year", "series", "raw_value")


# Dashboards ---------------------------------------------------------------------------

MONTH_AXIS_SQL = """months as (
  select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month))::date as m from orders)"""


def _dashboard(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """One page per segment: a grid with a row per region and a column per month."""
    counts = settled(standins.monthly_orders(spark, d)).withColumn("m", F.make_date("year", "month", F.lit(1)))
    ends = counts.agg(F.struct(F.min("m").alias("first"), F.max("m").alias("last"))).scalar()
    axis = F.sequence(ends["first"], ends["last"], F.expr("interval 1 month"))
    filled = R.fill_periods(counts, ["series", "geo"], "m", ["n"], axis)
    cells = F.sort_array(F.collect_list(F.struct("m", F.when(F.col("n") == 0, "*").otherwise(F.col("n").cast("string")).alias("text"))))
    cell = lambda role, text: F.concat(F.lit(f'<div role="{role}"><span>'), text, F.lit("</span></div>"))
    rows = filled.groupBy("series", "geo").agg(
        F.concat(
            F.lit('<div role="row">'), cell("rowheader", F.col("geo")),
            F.array_join(F.transform(cells, lambda c: cell("gridcell", c["text"])), ""), F.lit("</div>"),
        ).alias("row"),
        F.array_join(F.transform(cells, lambda c: cell("columnheader", F.date_format(c["m"], "MMM"))), "").alias("head"),
    )
    page = F.concat(
        F.lit('<main><div role="grid"><div role="row"><div role="columnheader">Month</div></div><div role="row">'),
        # all rows share one axis, so any of them gives the header
        cell("columnheader", F.lit("")), F.first("head"), F.lit("</div>"),
        F.array_join(F.sort_array(F.collect_list("row")), ""), F.lit("</div></main>"),
    )
    pages = rows.groupBy("series").agg(page.alias("html")).select(
        F.ascii("series").cast("long").alias("page_id"), F.initcap("series").alias("selection"), F.lit("Orders by Month").alias("title"), "html"
    )
    return pages, F.year(ends["last"])


@query(f"""with {standins.MONTHLY_SQL}, {MONTH_AXIS_SQL},
k as (select distinct series, geo from monthly)
select upper(left(k.series, 1)) || lower(substr(k.series, 2)) || ': Orders by Month' as title, k.geo as label, strftime(m, '%b') as header,
       year(m)::integer as "year", coalesce(n::varchar, '*') as raw_value, n::double as value, n is null as is_suppressed
from k cross join months left join monthly q on q.series = k.series and q.geo = k.geo and q.year = year(m) and q.month = month(m)""")
def dashboard_month_grid(spark: SparkSession, d: str) -> DataFrame:
    pages, base_year = _dashboard(spark, d)
    return feeds.dashboard_tables(pages, base_year, "monthly").drop("grid_no", "row_no")


# Three columns a year, the first two under the same label.
YEAR_LABELS = ("Orders", "Orders", "Percent")


@query(f"""with {standins.MONTHLY_SQL},
k as (select distinct series, geo from monthly), a as (select distinct year from monthly),
c as (select series, geo, year, sum(n)::bigint as n, coalesce(sum(n) filter (month <= 6), 0)::bigint as half from monthly group by all),
cells as (
  select k.series, k.geo, a.year, unnest(['Orders', 'Orders', 'Percent']) as header,
         unnest([coalesce(n::varchar, '*'), coalesce(half::varchar, '*'), coalesce((100 * half // n) || '%', '*')]) as raw_value,
         unnest([n, half, 100 * half // n])::double as value
  from k cross join a left join c on c.series = k.series and c.geo = k.geo and c.year = a.year)
select upper(left(series, 1)) || lower(substr(series, 2)) || ': Orders by Year' as title, geo as label, header, "year"::integer as "year",
       raw_value, value, raw_value = '*' as is_suppressed
from cells""")
def dashboard_year_grid(spark: SparkSession, d: str) -> DataFrame:
    """A dashboard whose second header row repeats from year to year, with one label twice in a year."""
    monthly = standins.monthly_orders(spark, d)
    half = F.coalesce(F.sum(F.when(F.col("month") <= 6, F.col("n"))), F.lit(0)).alias("half")
    counts = settled(monthly.groupBy("series", "geo", "year").agg(F.sum("n").alias("n"), half))
    axis, last = R.shared_axis(counts, "year"), counts.agg(F.max("year")).scalar()
    filled = R.fill_periods(counts, ["series", "geo"], "year", ["n", "half"], axis)
    shown = F.when(F.col("n") == 0, F.array(*[F.lit("*")] * 3)).otherwise(
        F.array(F.col("n").cast("string"), F.col("half").cast("string"), F.concat(F.expr("100 * half div n"), F.lit("%")))
    )
    cells = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("year", shown.alias("cells")))), lambda y: y["cells"]))
    cell = lambda role, text: F.concat(F.lit(f'<div role="{role}">'), text, F.lit("</div>"))
    rows = filled.groupBy("series", "geo").agg(F.concat(
        F.lit('<div role="row">'), cell("rowheader", F.col("geo")), F.array_join(F.transform(cells, lambda c: cell("gridcell", c)), ""), F.lit("</div>"),
    ).alias("row"), F.size(cells).alias("columns"))
    labels = F.flatten(F.array_repeat(F.array(*[cell("columnheader", F.lit(c)) for c in YEAR_LABELS]), F.expr("int(first(columns) div 3)")))
    page = F.concat(
        F.lit('<main><div role="grid"><div role="row"><div role="columnheader">Year</div></div><div role="row">'),
        cell("columnheader", F.lit("")), F.array_join(labels, ""), F.lit("</div>"), F.array_join(F.sort_array(F.collect_list("row")), ""), F.lit("</div></main>"),
    )
    pages = rows.groupBy("series").agg(page.alias("html")).select(
        F.ascii("series").cast("long").alias("page_id"), F.initcap("series").alias("selection"), F.lit("Orders by Year").alias("title"), "html"
    )
    return feeds.dashboard_tables(pages, last, "yearly").drop("grid_no", "row_no")


# Marts from printed tables ---------------------------------------------------------------


def _year_wide(counts: DataFrame, label: str) -> DataFrame:
    return counts.groupBy(label).pivot("year").agg(F.sum("n"))


@query(f"""with {standins.SAMPLES_SQL},
axis as (select distinct year from samples), g as (select distinct geo from samples)
select g.geo, a.year, g.geo as series, 'counts' as metric, nullif(count(s.year), 0)::varchar as raw_value,
       nullif(count(s.year), 0)::double as value
from g cross join axis a left join samples s on s.geo = g.geo and s.year = a.year group by g.geo, a.year""")
def mart_year_table(spark: SparkSession, d: str) -> DataFrame:
    """A printed table with a column per year to the long shape."""
    counts = standins.supplier_year_counts(spark, d)
    return harm_marts.year_table(_year_wide(counts, "geo"), "geo", "counts")


@query(f"""with {BRAND_SQL},
c as (select brand, p_type, year, count(*)::bigint as n from samples group by all),
m as (select r_name as authority, n_nationkey from nation join region on n_regionkey = r_regionkey),
p as (select 'Brand#' || n_nationkey as location, authority from m where n_nationkey % 5 <> 0)
select coalesce(authority, 'Unknown') as authority, year, sum(n)::bigint as count
from c left join p on p.location = c.brand group by 1, 2""")
def mart_deaths_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Place lines of the reports, summed by the authority of the place."""
    counts = _brand_counts(spark, d, reused=False)
    places = counts.select(F.col("brand").alias("location"), "year", F.col("n").cast("string").alias("raw_value"))
    nations, regions = table(spark, d, "nation").filter("n_nationkey % 5 <> 0"), table(spark, d, "region")
    region_map = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.concat(F.lit("Brand#"), "n_nationkey").alias("location"), F.col("r_name").alias("authority"), F.lit(0).alias("position")
    )
    return harm_marts.deaths_by_place(places, region_map)


@query(f"""with {BRAND_SQL},
c as (select brand, year, p_type, count(*)::bigint as n from samples group by all),
t as (select brand, year, sum(n)::bigint as total from c group by all),
q as (select year(o_orderdate)::integer as year, count(distinct o_custkey)::bigint as population from orders group by all),
m as (select c.brand, p_type as series, c.year, n::double as n, total, population
      from c join t on t.brand = c.brand and t.year = c.year left join q on q.year = c.year)
select brand as geo, series, year, 'counts' as metric, n as value from m
union all select brand, series, year, 'percentages', round_even(n / total * 100.0, 2) from m
union all select brand, series, year, 'rates', round_even(n / population * 100000.0, 2) from m""")
def mart_opioid_types(spark: SparkSession, d: str) -> DataFrame:
    """Drug lines of the reports, one per brand: count, percent of the confirmed total and rate."""
    counts = _brand_counts(spark, d, F.col("p_type"), F.col("l_returnflag"))
    rows = counts.select(
        F.col("brand").alias("geo"), "year", _manner().alias("manner"), F.col("p_type").alias("drug"), F.col("n").cast("string").alias("raw_value")
    )
    people = M.tally(table(spark, d, "orders").select("o_custkey", standins.year("o_orderdate")).distinct(), ["year"], name="population")
    people = rows.select("geo", "year").distinct().join(people, "year")
    return harm_marts.deaths_by_opioid_type(rows, harm_marts.confirmed_totals(rows), people)
