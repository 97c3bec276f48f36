"""Queries over the order stand-ins: rates, percentages, crosstabs, suppression and national views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.functions import numbers as N, periods as P
from tallymark.functions.text import NBSP
from tallymark.operators import measures as M, presentation as V, reshape as R
from tallymark.plans import harm_marts, standins
from tallymark.plans.registry import query, table
from tallymark.plans.settle import settled
from tallymark.plans.standins import MONTHLY_SQL, POPULATION_SQL, SAMPLES_SQL

SELECTED = ("NATION_0", "NATION_3", "NATION_7", "NATION_12")
SELECTED_SQL = "('NATION_0', 'NATION_3', 'NATION_7', 'NATION_12')"
MONTH_COLUMNS = [str(m) for m in range(1, 13)]

RATE_SQL = f"""with {MONTHLY_SQL}, {POPULATION_SQL},
yearly as (select geo, year, sum(n)::bigint as n from monthly group by all)"""


@query(f"""{RATE_SQL}
select y.geo, y.year, y.n, p.population, round_even(y.n::double / p.population * 100000.0, 2) as rate
from yearly y left join population p on p.geo = y.geo and p.year = y.year""")
def rate_per_100k_same_year(spark: SparkSession, d: str) -> DataFrame:
    return M.add_rate(standins.yearly_orders(spark, d), standins.population(spark, d), "n")


@query(f"""{RATE_SQL}
select y.geo, y.year, y.n, p.population, round_even(y.n::double / p.population * 100000.0, 2) as rate
from yearly y left join population p on p.geo = y.geo and p.year = (select max(year) from yearly)""")
def rate_per_100k_latest_year(spark: SparkSession, d: str) -> DataFrame:
    yearly = settled(standins.yearly_orders(spark, d))
    return M.add_rate(yearly, standins.population(spark, d), "n", "latest_year")


PERCENT_SQL = """with counts as (
  select year(l_shipdate)::integer as year, p_type as series, count(*)::bigint as n
  from lineitem join part on l_partkey = p_partkey group by all),
totals as (select year, sum(n)::bigint as total from counts group by all),
percents as (
  select year, series, round_even(n::double / total * 100.0, 1) as percent, total
  from counts join totals using (year))"""


def _percents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Published percentages (one decimal) per year and series, and the yearly totals."""
    counts = settled(standins.sample_counts(spark, d)).withColumnRenamed("category", "series")
    shared = M.share_of_total(counts, ["year"], "n")
    percents = shared.select(
        "year", "series", N.half_even(F.col("n").cast("double") / F.col("total").cast("double") * 100.0, 1).alias("percent")
    )
    return percents, M.tally(counts, ["year"], "n", "total")


@query(f"""{PERCENT_SQL}
select year, series, percent, total, round_even(percent * total / 100.0, 0)::bigint as count,
       round_even(floor(percent) * total / 100.0, 0)::bigint as count_truncated
from percents""")
def count_from_percent(spark: SparkSession, d: str) -> DataFrame:
    percents, totals = _percents(spark, d)
    counted = M.add_count_from_percent(percents, totals, ["year"])
    return counted.withColumn("count_truncated", N.count_from_percent(F.col("percent"), F.col("total"), truncate=True))


@query(f"""with {MONTHLY_SQL},
c as (select geo, year, sum(n) filter (series = 'BUILDING') as part_n, sum(case when geo = 'NATION_5' then 0 else n end) as total
      from monthly group by all)
select geo, year, coalesce(part_n, 0)::bigint as n, total::bigint as total,
       coalesce(round_even(coalesce(part_n, 0)::double / nullif(total, 0)::double * 100.0, 2), 0.0) as percent,
       case when total = 0 then 0.0 else round_even(coalesce(part_n, 0)::double / total::double * 100000.0, 2) end as rate
from c""")
def percent_zero_safe(spark: SparkSession, d: str) -> DataFrame:
    counts = standins.monthly_orders(spark, d).groupBy("geo", "year").agg(
        F.sum(F.when(F.col("series") == "BUILDING", F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("geo") == "NATION_5", 0).otherwise(F.col("n"))).alias("total"),
    )
    return counts.withColumns({
        "percent": N.percent_or_zero(F.col("n"), F.col("total")),
        "rate": N.rate_or_zero(F.col("n"), F.col("total")),
    })


YEAR_POPULATION_SQL = "people as (select year(o_orderdate)::integer as year, count(distinct o_custkey)::bigint as population from orders group by all)"


@query(f"""{PERCENT_SQL}, {YEAR_POPULATION_SQL}
select year, series, percent, total, round_even(percent * total / 100.0, 0)::bigint as count, population,
       round_even(round_even(percent * total / 100.0, 0) / population * 100000.0, 2) as rate
from percents join people using (year)""")
def composed_rate_from_percent(spark: SparkSession, d: str) -> DataFrame:
    percents, totals = _percents(spark, d)
    people = M.tally(table(spark, d, "orders").select("o_custkey", standins.year("o_orderdate")).distinct(), ["year"], name="population")
    counted = M.add_count_from_percent(percents, totals, ["year"]).join(people, "year")
    return counted.withColumn("rate", N.rate_per_100k(F.col("count"), F.col("population")))


@query(f"""with {SAMPLES_SQL}, {POPULATION_SQL},
counts as (select geo, year, category as series, count(*)::bigint as n from samples group by all),
totals as (select geo, year, sum(n)::bigint as total from counts group by all),
percents as (select geo, year, series, total, round_even(n::double / total * 100.0, 2) as percent from counts join totals using (geo, year)),
m as (select p.*, round_even(percent * total / 100.0, 0) as count, population
      from percents p left join population q on q.geo = p.geo and q.year = p.year)
select geo, series, year, 'percentages' as metric, percent as value from m
union all select geo, series, year, 'counts', count from m
union all select geo, series, year, 'rates', round_even(count / population * 100000.0, 2) from m""")
def mart_percent_count_rate(spark: SparkSession, d: str) -> DataFrame:
    """The composition mart over indicator rows in their landed form."""
    counts = settled(standins.regional_sample_counts(spark, d))
    shares = M.share_of_total(counts, ["geo", "year"], "n")
    shape = [F.col("geo").alias("Region"), F.lit("Deaths").alias("Source"), F.lit("Opioids").alias("Substance")]
    period = [F.lit("By year").alias("Time_Period"), F.col("year").cast("string").alias("Year_Quarter")]
    landed = R.stack_rows(
        shares.select(
            *shape, F.lit("Type of opioids").alias("Specific_Measure"), F.col("category").alias("Disaggregator"), *period,
            F.lit("Percent").alias("Unit"), F.concat(F.col("percent").cast("string"), F.lit("%")).alias("Value"),
        ),
        M.tally(counts, ["geo", "year"], "n", "total").select(
            *shape, F.lit("Overall numbers").alias("Specific_Measure"), F.lit(None).cast("string").alias("Disaggregator"),
            *period, F.lit("Number").alias("Unit"), F.col("total").cast("string").alias("Value"),
        ),
    )
    ind = harm_marts.typed_indicators(landed)
    return harm_marts.deaths_by_drug_type(ind, standins.population(spark, d)).drop("substance")


@query(f"""{RATE_SQL}, ends as (select max(o_orderdate) as last from orders)
select y.geo, y.year,
       case when y.year = year(last) and month(last) < 12 then y.year || ' (Jan to ' || strftime(last, '%b') || ')' else y.year::varchar end as label,
       y.year = year(last) and month(last) < 12 as is_partial,
       case when y.n < 40 then 'Suppr.' else y.n::varchar end as raw_value, y.n < 40 as is_suppressed,
       case when y.n >= 40 then y.n::double end as count,
       case when y.n >= 40 then round_even(y.n::double / p.population * 100000.0, 2) end as rate
from yearly y left join population p on p.geo = y.geo and p.year = y.year cross join ends""")
def mart_national(spark: SparkSession, d: str) -> DataFrame:
    landed = _landed_totals(spark, d)
    ind = harm_marts.typed_indicators(landed)
    rows = harm_marts.yearly(ind, measure="Overall numbers", unit="Number", substance="Opioids")
    rated = M.add_rate(rows, standins.population(spark, d), "value")
    return rated.select("geo", "year", "label", "is_partial", "raw_value", "is_suppressed", F.col("value").alias("count"), "rate")


def _landed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Yearly order counts as landed indicator rows: last year partial, small values suppressed."""
    last = table(spark, d, "orders").agg(F.max("o_orderdate")).scalar()
    open_year = (F.col("year") == F.year(last)) & (F.month(last) < 12)
    label = F.when(open_year, F.concat(F.col("year"), F.lit(" (Jan to "), F.date_format(last, "MMM"), F.lit(")")))
    return standins.yearly_orders(spark, d).select(
        F.col("geo").alias("Region"), F.lit("Deaths").alias("Source"), F.lit("Opioids").alias("Substance"),
        F.lit("Overall numbers").alias("Specific_Measure"), F.lit(None).cast("string").alias("Disaggregator"),
        F.lit("By year").alias("Time_Period"), F.concat(F.coalesce(label, F.col("year").cast("string")), F.lit(NBSP)).alias("Year_Quarter"),
        F.lit("Number").alias("Unit"), F.when(F.col("n") < 40, "Suppr.").otherwise(F.col("n").cast("string")).alias("Value"),
    )


@query(f"""{RATE_SQL}, ends as (select max(o_orderdate) as last from orders),
part as (select geo, year, 'Jan to ' || strftime(last, '%b') as months from yearly cross join ends
         where year = year(last) and month(last) < 12)
select year, months, string_agg(geo, ', ' order by geo) as regions,
       string_agg(geo, ', ' order by geo) || ' contain data only for ' || months || ' in the year ' || year || '.' as note
from part group by year, months""")
def partial_period_note(spark: SparkSession, d: str) -> DataFrame:
    return M.partial_period_notes(_landed_totals(spark, d), "Year_Quarter", "Region")


@query(f"""with {MONTHLY_SQL},
printed as (select geo, year, case when n < 5 then 'Suppr.' else n::varchar end as raw from monthly)
select year, sum(coalesce(try_cast(raw as double), 0)) as total from printed group by year""")
def national_totals(spark: SparkSession, d: str) -> DataFrame:
    shown = standins.monthly_orders(spark, d).withColumn("raw", standins.printed())
    return V.national_total(shown, "year", "raw")


@query(f"""with {MONTHLY_SQL},
t as (select year, sum(n) as total from monthly where geo in {SELECTED_SQL} group by year),
p as (select max(total)::bigint as peak from t)
select peak, case when length(peak::varchar) >= 4 then ceil(peak / 1000.0) * 1000
                  when length(peak::varchar) = 3 then ceil(peak / 100.0) * 100
                  else ceil(peak / 10.0) * 10 end::bigint as axis_end from p""")
def selected_regions_total_peak(spark: SparkSession, d: str) -> DataFrame:
    return V.selected_peak(standins.yearly_orders(spark, d), SELECTED, "geo", "year", "n")


@query(f"""with {MONTHLY_SQL}
select year, sum(n)::bigint as total from monthly where geo in {SELECTED_SQL} group by year""")
def selected_regions_total(spark: SparkSession, d: str) -> DataFrame:
    return V.selected_total(standins.yearly_orders(spark, d), SELECTED, "geo", "year", "n")


@query(f"""with {MONTHLY_SQL},
y as (select geo, year, sum(n)::bigint as n from monthly where geo in {SELECTED_SQL} group by all)
select geo, year, n, (sum(n) over (partition by year))::bigint as total,
       round_even(n::double / sum(n) over (partition by year) * 100.0, 2) as percent,
       (sum(n) over (partition by year order by geo))::bigint as stacked
from y""")
def percent_of_total_stack(spark: SparkSession, d: str) -> DataFrame:
    yearly = settled(standins.yearly_orders(spark, d))
    shares = V.percent_stack(yearly, SELECTED, "geo", "year", "n")
    numbered = shares.withColumn("_no", F.array_position(F.array(*[F.lit(s) for s in sorted(SELECTED)]), F.col("geo")))
    return V.stack_heights(numbered, "year", "_no", "n").drop("_no")


ALIGNED_SQL = f"""with {MONTHLY_SQL},
c as (select series, year, sum(n)::bigint as n from monthly where series <> 'FURNITURE' or year >= 1998 group by all)"""


@query(f"""{ALIGNED_SQL}
select s.series, a.year, coalesce(c.n, 0)::bigint as n
from (select distinct series from c) s cross join (select distinct year from c) a
left join c on c.series = s.series and c.year = a.year""")
def aligned_series_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    monthly = standins.monthly_orders(spark, d).filter("series <> 'FURNITURE' or year >= 1998")
    counts = settled(M.tally(monthly, ["series", "year"], "n"))
    return R.fill_periods(counts, ["series"], "year", ["n"], R.shared_axis(counts, "year"))


def _month_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per segment and year, one column per month, as a workbook prints it."""
    monthly = standins.monthly_orders(spark, d).withColumn("month", F.col("month").cast("string"))
    return monthly.groupBy("series", "year").pivot("month", MONTH_COLUMNS).agg(F.sum("n"))


@query(f"""with {MONTHLY_SQL}
select series, year, sum(n)::double as value, 0::bigint as suppressed_months from monthly group by all""")
def wide_months_to_year_totals(spark: SparkSession, d: str) -> DataFrame:
    long = R.wide_to_long(_month_wide(spark, d), ["series", "year"], "month", "raw_value", MONTH_COLUMNS)
    return M.year_totals(long, ["series", "year"], "raw_value")


PRINTED_SQL = f"""with {MONTHLY_SQL},
printed as (
  select geo, series, year, month, make_date(year, month, 1) as month_start,
         case when n < 5 then 'Suppr.' else n::varchar end as raw_value
  from monthly)"""


def _printed(spark: SparkSession, d: str) -> DataFrame:
    return standins.monthly_orders(spark, d).select(
        "geo", "series", "year", "month", F.make_date("year", "month", F.lit(1)).alias("month_start"),
        standins.printed().alias("raw_value"),
    )


@query(f"""{PRINTED_SQL}
select geo, year, sum(try_cast(raw_value as double)) as value,
       count(*) filter (raw_value = 'Suppr.')::bigint as suppressed_months
from printed group by all""")
def suppressed_year_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.year_totals(_printed(spark, d), ["geo", "year"], "raw_value")


@query(f"""{PRINTED_SQL}
select geo, series, least(min(case when raw_value = 'Suppr.' then month_start end), max(month_start), date '2001-06-01') as complete_until
from printed group by all""")
def series_complete_until(spark: SparkSession, d: str) -> DataFrame:
    return M.complete_until(
        _printed(spark, d), ["geo", "series"], "raw_value", "month_start", F.lit("2001-06-01").cast("date")
    )


@query(f"""{PRINTED_SQL},
t as (select series, year, sum(try_cast(raw_value as double)) as value from printed group by all),
a as (select series, year, value from t union all select 'all drugs', year, sum(value) from t group by year),
u as (select series, least(min(case when raw_value = 'Suppr.' then month_start end), max(month_start), date '2001-12-31') as complete_until from printed group by all),
v as (select series, complete_until from u union all select 'all drugs', min(complete_until) from u)
select series, year, value, complete_until from a join v using (series)""")
def provincial_drug_totals(spark: SparkSession, d: str) -> DataFrame:
    monthly = settled(_printed(spark, d)).withColumn("as_of", F.lit("2001-12-31").cast("date"))
    return harm_marts.provincial_drug_totals(monthly)


@query(f"""with {MONTHLY_SQL}
select year, sum(n)::bigint as total from monthly group by year""")
def cross_series_total(spark: SparkSession, d: str) -> DataFrame:
    per_series = M.tally(standins.monthly_orders(spark, d), ["series", "year"], "n")
    return M.tally(per_series, ["year"], "n", "total")


@query("""select year(l_shipdate)::integer as year, sum(l_quantity) as l_quantity, sum(l_linenumber)::double as l_linenumber,
       count(*)::double as l_returnflag_rows
from lineitem group by all""")
def column_sums_and_group_sum(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        standins.year("l_shipdate"), "l_quantity", "l_linenumber", F.lit("1").alias("l_returnflag_rows")
    )
    return M.sum_columns(lines, ["year"], ["l_quantity", "l_linenumber", "l_returnflag_rows"])


@query(f"""with {MONTHLY_SQL}
select series, {", ".join(f'sum(case when year = {y} then n end)::bigint as "{y}"' for y in range(1995, 2002))}
from monthly group by series""")
def pivot_display_table(spark: SparkSession, d: str) -> DataFrame:
    yearly = M.tally(standins.monthly_orders(spark, d), ["series", "year"], "n")
    return R.long_to_wide(yearly, "series", "year", "n", list(range(1995, 2002)))


@query(f"""with {MONTHLY_SQL}
select geo, year, n, n::varchar || '%' as raw_value, n::double as value, false as is_suppressed
from (select geo, year, sum(n)::bigint as n from monthly group by all) y where n >= 5
union all
select geo, year, n, 'Suppr.', null, true from (select geo, year, sum(n)::bigint as n from monthly group by all) y where n < 5""")
def observed_values(spark: SparkSession, d: str) -> DataFrame:
    """Printed text with padding and percent signs to typed values and suppression flags."""
    yearly = standins.yearly_orders(spark, d)
    text = F.concat(F.when(F.col("n") < 5, "Suppr.").otherwise(F.concat("n", F.lit("%"))), F.lit(NBSP))
    return M.observe(yearly.withColumn("text", text), "text").drop("text")


@query(f"""with {MONTHLY_SQL}
select geo, year, sum(n)::bigint as n, strftime(make_date(year, 12, 31), '%B %d, %Y') as day_text,
       strftime(make_date(year, 12, 31), '%B, %Y') as month_text
from monthly group by all""")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    end = F.make_date("year", F.lit(12), F.lit(31))
    return standins.yearly_orders(spark, d).withColumns({"day_text": P.long_date(end), "month_text": P.month_and_year(end)})
