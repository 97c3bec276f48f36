"""The harm marts themselves as queries, over indicator rows in the form in which they land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.functions import numbers as N
from tallymark.operators import measures as M, reshape as R
from tallymark.plans import harm_marts, standins
from tallymark.plans.registry import query, table
from tallymark.plans.settle import settled
from tallymark.plans.standins import POPULATION_SQL, SAMPLES_SQL

FACTS_SQL = f"""facts as (
  select n_name as geo, year(l_shipdate)::integer as year, case l_linestatus when 'F' then 'Opioids' else 'Stimulants' end as substance,
         p_type as category, case l_returnflag when 'R' then 'Male' else 'Female' end as sex,
         case l_returnflag when 'A' then 'Accident' when 'N' then 'Suicide' else 'Undetermined' end as manner
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
t as (select geo, year, substance, count(*)::bigint as total from facts group by all), {POPULATION_SQL}"""


def _shares_sql(series: str, align: bool = False) -> str:
    """Percentages per series, and with ``align`` every series over the same years."""
    shares = f"""with {FACTS_SQL},
c as (select geo, year, substance, {series} as series, count(*)::bigint as n from facts group by all),
{"r" if align else "p"} as (select geo, year, substance, series, round_even(n::double / total * 100.0, 2) as percent, n from c join t using (geo, year, substance))"""
    if align:
        shares += """,
a as (select distinct year from r), k as (select distinct geo, substance, series from r),
p as (select k.geo, a.year, k.substance, k.series, coalesce(r.percent, 0.0) as percent
      from k cross join a left join r on r.geo = k.geo and r.substance = k.substance and r.series = k.series and r.year = a.year)"""
    return shares + """,
m as (select p.geo, p.substance, p.series, p.year, percent, round_even(percent * total / 100.0, 0) as count, population
      from p left join t on t.geo = p.geo and t.year = p.year and t.substance = p.substance
      left join population q on q.geo = p.geo and q.year = p.year)
select geo, substance, series, year, 'percentages' as metric, percent as value from m
union all select geo, substance, series, year, 'counts', count from m"""


RATES_SQL = "\nunion all select geo, substance, series, year, 'rates', round_even(count / population * 100000.0, 2) from m"


def _counts(spark: SparkSession, d: str, *keys: Column) -> DataFrame:
    """Line items per region, year, substance and the given keys.

    Line items are nearly unique in part and supplier, so they are not counted before the joins: they stream past hashed
    parts, and a task holds its share of the parts, never of the line items."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", standins.year("l_shipdate"), "l_linestatus", "l_returnflag")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    placed = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).drop("l_suppkey", "s_suppkey")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"))
    typed = placed.join(parts.hint("shuffle_hash"), placed.l_partkey == parts.p_partkey)
    substance = F.when(F.col("l_linestatus") == "F", "Opioids").otherwise("Stimulants").alias("substance")
    counted = M.tally(typed, ["s_nationkey", "year", substance, *keys])
    nations = standins.nation_names(spark, d)
    named = counted.join(nations, counted.s_nationkey == nations.n_nationkey)
    return M.tally(named, [c for c in ("geo", *counted.columns) if c not in ("s_nationkey", "n")], "n")


def _landed(spark: SparkSession, d: str, series: Column, measures: dict[str, str], crude: bool = False) -> DataFrame:
    """Typed indicator rows: the share of each series, the overall number, and a crude rate if asked for."""
    counts = settled(_counts(spark, d, series.alias("series")))
    shares = M.share_of_total(counts, ["geo", "year", "substance"], "n")
    shape = [F.col("geo").alias("Region"), F.lit("Deaths").alias("Source"), F.col("substance").alias("Substance")]
    period = [F.lit("By year").alias("Time_Period"), F.col("year").cast("string").alias("Year_Quarter")]
    measure = F.lit(None).cast("string")
    for substance, name in measures.items():
        measure = F.when(F.col("substance") == substance, name).otherwise(measure)

    def rows(df: DataFrame, measure: Column, series: Column, unit: str, value: Column) -> DataFrame:
        return df.select(
            *shape, measure.alias("Specific_Measure"), series.alias("Disaggregator"), *period,
            F.lit(unit).alias("Unit"), value.cast("string").alias("Value"),
        )

    parts = [
        rows(shares, measure, F.col("series"), "Percent", F.concat(F.col("percent").cast("string"), F.lit("%"))),
        rows(M.tally(counts, ["geo", "year", "substance"], "n", "n"), F.lit("Overall numbers"), F.lit(None).cast("string"), "Number", F.col("n")),
    ]
    if crude:
        parts.append(rows(counts, measure, F.col("series"), "Crude rate", F.col("n")))
    return harm_marts.typed_indicators(R.stack_rows(*parts))


def _manner() -> Column:
    return F.when(F.col("l_returnflag") == "A", "Accident").when(F.col("l_returnflag") == "N", "Suicide").otherwise("Undetermined")


@query(f"select * from ({_shares_sql('category')}) where substance = 'Opioids'")
def mart_deaths_by_age(spark: SparkSession, d: str) -> DataFrame:
    return harm_marts.deaths_by_age(_landed(spark, d, F.col("category"), {"Opioids": "Age group", "Stimulants": "Age group"}))


@query(_shares_sql("category") + RATES_SQL)
def mart_drug_types_both(spark: SparkSession, d: str) -> DataFrame:
    """Opioid and stimulant types together."""
    ind = _landed(spark, d, F.col("category"), {"Opioids": "Type of opioids", "Stimulants": "Type of stimulants"})
    return harm_marts.deaths_by_drug_type(ind, standins.population(spark, d))


@query(_shares_sql("sex", True) + "\nunion all select geo, substance, series, year, 'rates', n::double from r")
def mart_deaths_by_sex(spark: SparkSession, d: str) -> DataFrame:
    sex = F.when(F.col("l_returnflag") == "R", "Male").otherwise("Female")
    return harm_marts.deaths_by_sex(_landed(spark, d, sex, {"Opioids": "Sex", "Stimulants": "Sex"}, crude=True))


@query(_shares_sql("manner", True) + RATES_SQL)
def mart_deaths_by_manner(spark: SparkSession, d: str) -> DataFrame:
    ind = _landed(spark, d, _manner(), {"Opioids": "Manner of death", "Stimulants": "Manner of death"})
    return harm_marts.deaths_by_manner(ind, standins.population(spark, d))


def _wide(counts: DataFrame, label: str, value: str) -> DataFrame:
    """A printed table: a column per year of the data."""
    return counts.groupBy(label).pivot("year").agg(F.first(value))


YEARS_SQL = f"""with {SAMPLES_SQL}, {POPULATION_SQL},
a as (select distinct year from samples), g as (select distinct geo from samples),
c as (select geo, year, count(*)::bigint as n from samples group by all),
v as (select g.geo, a.year, c.n, round_even(c.n::double / population * 100000.0, 2) as rate
      from g cross join a left join c on c.geo = g.geo and c.year = a.year left join population q on q.geo = g.geo and q.year = a.year)"""


@query(f"""{YEARS_SQL}
select geo, year, geo as series, 'counts' as metric, n::double as value from v
union all select geo, year, geo, 'rates', rate from v""")
def mart_regional_heatmap(spark: SparkSession, d: str) -> DataFrame:
    counts = standins.supplier_year_counts(spark, d)
    rated = settled(M.add_rate(counts, standins.population(spark, d), "n"))
    return harm_marts.regional_heatmap(_wide(rated, "geo", "n"), _wide(rated, "geo", "rate"), "geo", "geo").drop("raw_value")


@query(f"""with {SAMPLES_SQL}, people as (select year(o_orderdate)::integer as year, count(distinct o_custkey)::bigint as population from orders group by all),
a as (select distinct year from samples), k as (select distinct category as series from samples),
c as (select category as series, year, count(*)::bigint as n from samples group by all), t as (select year, sum(n)::bigint as total from c group by year),
m as (select k.series, a.year, round_even(n::double / total * 100.0, 2) as percent, total, population
      from k cross join a left join c on c.series = k.series and c.year = a.year left join t on t.year = a.year left join people q on q.year = a.year),
v as (select *, round_even(percent * total / 100.0, 0) as count from m)
select 'BC' as geo, series, year, 'percentages' as metric, percent as value from v
union all select 'BC', series, year, 'counts', count from v
union all select 'BC', series, year, 'rates', round_even(count / population * 100000.0, 2) from v""")
def mart_deaths_per_drug(spark: SparkSession, d: str) -> DataFrame:
    """A printed table of percentages, with counts from the yearly totals and rates."""
    counts = settled(standins.sample_counts(spark, d)).withColumnRenamed("category", "series")
    printed = F.concat(F.col("percent").cast("string"), F.lit("%"))
    percents = M.share_of_total(counts, ["year"], "n").withColumn("shown", printed)
    totals = M.tally(counts, ["year"], "n", "total").withColumn("geo", F.lit("BC"))
    active = table(spark, d, "orders").select("o_custkey", standins.year("o_orderdate")).distinct()
    people = M.tally(active, ["year"], name="population").withColumn("geo", F.lit("BC"))
    return harm_marts.deaths_per_drug(_wide(percents, "series", "shown"), totals, people, "series", "BC")


@query(f"""with {SAMPLES_SQL},
a as (select distinct year from samples), k as (select distinct case category when 'PROMO' then 'Age Unavailable' else category end as series, category from samples),
c as (select category, year, count(*)::bigint as n from samples group by all),
v as (select series, a.year, n from k cross join a left join c on c.category = k.category and c.year = a.year
      union all select 'Total', year, sum(n)::bigint from c group by year)
select 'BC' as geo, year, series, 'counts' as metric, n::double as value, series = 'Total' as is_total from v
union all select 'BC', year, series, 'rates', round_even(n / 7.0, 2), series = 'Total' from v""")
def mart_age_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of counts and rates with a total row and a row of unknown age."""
    counts = settled(standins.sample_counts(spark, d))
    label = F.when(F.col("category") == "PROMO", "Not available").otherwise(F.col("category")).alias("label")
    rows = settled(R.stack_rows(counts.select(label, "year", "n"), M.tally(counts, ["year"], "n", "n").select(F.lit("Total").alias("label"), "year", "n")))
    rows = rows.withColumn("rate", N.half_even(F.col("n").cast("double") / 7.0))
    return harm_marts.deaths_by_age_tables(_wide(rows, "label", "n"), _wide(rows, "label", "rate"), "label", "BC").drop("raw_value")


@query(f"""with {standins.MONTHLY_SQL},
u as (select geo as unit, year, month, sum(n)::bigint as n from monthly group by all
      union all select 'All', year, month, sum(n)::bigint from monthly group by all)
select unit, year, sum(case when n >= {standins.SMALL} then n end)::double as value, count(*) filter (n < {standins.SMALL})::bigint as suppressed_months,
       case unit when 'All' then 'province' else 'health_unit' end as geo_type
from u group by unit, year""")
def mart_unit_year_totals(spark: SparkSession, d: str) -> DataFrame:
    """Monthly values per health unit, with a printed total, to yearly totals."""
    monthly = standins.monthly_orders(spark, d)
    units = M.tally(monthly, [F.col("geo").alias("unit"), "year", "month"], "n", "n")
    whole = M.tally(monthly, [F.lit("All").alias("unit"), "year", "month"], "n", "n")
    return harm_marts.unit_year_totals(R.stack_rows(units, whole).withColumn("raw_value", standins.printed()).drop("n"))
