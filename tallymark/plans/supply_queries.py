"""Queries over the sample stand-in: categories, strips, keywords, tokens, slices and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.functions import numbers as N
from tallymark.operators import measures as M, presentation as V, reshape as R, select as S
from tallymark.plans import sample_marts, standins
from tallymark.plans.registry import query, table
from tallymark.plans.settle import settled
from tallymark.plans.standins import SAMPLES_SQL

WORDS = ("red", "hot", "large", "gear", "ring", "old")

FILLED_SQL = f"""{SAMPLES_SQL},
axis as (select distinct year from samples),
filled as (
  select a.year, c.category, count(s.year)::bigint as n
  from axis a cross join (select distinct category from samples) c
  left join samples s on s.year = a.year and s.category = c.category
  group by all)"""


@query(f"""with {FILLED_SQL}
select year, category, n, (sum(n) over (partition by year))::bigint as total,
       round_even(n::double / sum(n) over (partition by year) * 100.0, 2) as percent
from filled""")
def supply_by_category_year(spark: SparkSession, d: str) -> DataFrame:
    counts = settled(standins.sample_counts(spark, d))
    filled = R.fill_periods(counts, ["category"], "year", ["n"], R.shared_axis(counts, "year"))
    return M.share_of_total(filled, ["year"], "n")


@query(f"""with c as (
  select year(l_shipdate)::integer as year, count(*)::bigint as total,
         count(*) filter (l_returnflag = 'R')::bigint as fentanyl,
         count(*) filter (l_linestatus = 'F')::bigint as benzo
  from lineitem group by all),
l as (select year, total, 'Fentanyl' as series, fentanyl as n from c
      union all select year, total, 'Benzodiazepines', benzo from c)
select year, total, series, n, round_even(n::double / total * 100.0, 2) as percent from l""")
def strip_positivity_by_year(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "lineitem").select(
        standins.year("l_shipdate"), (F.col("l_returnflag") == "R").alias("fentanyl_pos"),
        (F.col("l_linestatus") == "F").alias("benzo_pos"),
    )
    return sample_marts.strip_positivity(samples)


@query(f"""with {SAMPLES_SQL},
w as (select unnest(['red', 'hot', 'large', 'gear', 'ring', 'old']) as series),
c as (
  select year, series, count(*) filter (contains(lower(p_name), series))::bigint as n, count(*)::bigint as total
  from samples cross join w where category = 'PROMO' group by all)
select year, series, n, total, round_even(n::double / total * 100.0, 2) as percent from c""")
def keyword_types_in_class(spark: SparkSession, d: str) -> DataFrame:
    # the class slice is pushed through the join to the part scan
    named = standins.sample_counts(spark, d, "p_name").filter(F.col("category") == "PROMO")
    return M.keyword_counts(named, ["year"], F.col("p_name"), WORDS, weight="n")


@query(f"""with {SAMPLES_SQL}
select geo, year, category, count(*)::bigint as n, grouping(category) = 1 as is_total
from samples group by grouping sets ((geo, year, category), (geo, year))""")
def regional_supply_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.grouped_totals(standins.regional_sample_counts(spark, d), ["geo", "year", "category"], "n")


@query(f"""with {SAMPLES_SQL},
numbered as (select row_number() over () as id, * from samples),
tokens as (select id, geo, year, category, unnest(string_split(p_name, ' ')) as token from numbered)
select geo, year, category, token, count(*)::bigint as occurrences, count(distinct id)::bigint as samples
from tokens group by all""")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    named = standins.regional_sample_counts(spark, d, "p_name")
    findings = named.withColumn("findings", F.split("p_name", " "))
    return M.token_counts(findings, ["geo", "year", "category"], "findings", weight="n")


@query(f"""with {SAMPLES_SQL},
axis as (select unnest(range(min(year), max(year) + 1))::integer as year from samples),
series as (select distinct category as series from samples where category not in ('LARGE'))
select series, year from axis cross join series""")
def series_axis_spine(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    years = table(spark, d, "lineitem").select(standins.year("l_shipdate"))
    axis = R.year_axis(years.agg(F.min("year")).scalar(), years.agg(F.max("year")).scalar())
    used = parts.join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    series = S.without_labels(M.distinct_values(used.withColumnRenamed("p_type", "series"), "series"), "series", ["LARGE"])
    return series.select("series", F.explode(axis).alias("year"))


EARLY_SQL = f"""with {SAMPLES_SQL},
base as (select category as series, year, count(*)::bigint as n from samples group by all),
mart as (
  select series, year,
         case when series = 'PROMO' and year < 1997 then 0 when series = 'SMALL' then 0 else n end::bigint as n
  from base)"""


def _series_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    """Counts per category in which one series starts late and one is empty."""
    late = (F.col("series") == "PROMO") & (F.col("year") < 1997)
    mart = standins.sample_counts(spark, d).withColumnRenamed("category", "series")
    return mart.withColumn("n", F.when(late | (F.col("series") == "SMALL"), F.lit(0)).otherwise(F.col("n")).cast("bigint"))


@query(f"""{EARLY_SQL},
f as (select *, min(case when n <> 0 then year end) over (partition by series) as first from mart)
select series, year, n from f where year >= first""")
def leading_zero_trim(spark: SparkSession, d: str) -> DataFrame:
    return V.trim_leading_zeros(_series_with_zeros(spark, d), ["series"], "year", "n").select("series", "year", "n")


@query(f"""{EARLY_SQL},
f as (select *, min(case when n <> 0 then year end) over (partition by series) as first from mart)
select series, year, n, case when year < first then 'No Data' else n::varchar end as shown from f""")
def leading_zero_text(spark: SparkSession, d: str) -> DataFrame:
    return V.leading_zeros_as_text(_series_with_zeros(spark, d), ["series"], "year", "n").select("series", "year", "n", "shown")


@query(f"""{EARLY_SQL}
select series, min(year) as first_period from mart where n <> 0 group by all""")
def first_year_with_data(spark: SparkSession, d: str) -> DataFrame:
    return V.first_period_with_data(_series_with_zeros(spark, d), ["series"], "year", "n")


@query(f"""{EARLY_SQL}
select series, year, n from mart where series in (select series from mart where n <> 0)""")
def all_zero_measure_gate(spark: SparkSession, d: str) -> DataFrame:
    return M.drop_empty_measures(settled(_series_with_zeros(spark, d)), ["series"], "n").select("series", "year", "n")


@query(f"""{EARLY_SQL}
select series, year, n from mart where n <> 0""")
def nonzero_slices(spark: SparkSession, d: str) -> DataFrame:
    return V.drop_zero_slices(_series_with_zeros(spark, d), "n").select("series", "year", "n")


@query(f"""{EARLY_SQL}
select series from mart group by series having not bool_or(n <> 0)""")
def empty_charts(spark: SparkSession, d: str) -> DataFrame:
    return V.empty_periods(_series_with_zeros(spark, d), ["series"], "n")


@query(f"""with {SAMPLES_SQL}
select geo, year, category, count(*)::bigint as n from samples
where geo = 'NATION_3' and year = 1997 and category = 'PROMO' group by all""")
def drill_geo_year_category(spark: SparkSession, d: str) -> DataFrame:
    return S.drill(standins.regional_sample_counts(spark, d, only=1997), "NATION_3", 1997, "PROMO")


@query(f"""with c as (
  select p_type as category, count(*) filter (l_returnflag = 'R')::bigint as n, count(*)::bigint as total
  from lineitem join part on l_partkey = p_partkey
  where l_shipdate >= date '1998-01-01' and l_shipdate < date '1999-01-01' group by all)
select category, n, total, round_even(n::double / total * 100.0, 2) as percent from c""")
def positive_in_one_year(spark: SparkSession, d: str) -> DataFrame:
    one_year = table(spark, d, "lineitem").filter(S.in_year(F.col("l_shipdate"), 1998))
    by_part = M.flagged_counts(one_year, ["l_partkey"], {"n": F.col("l_returnflag") == "R"})
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"))
    totals = by_part.join(parts, by_part.l_partkey == parts.p_partkey).groupBy("category").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    return totals.withColumn("percent", N.percent_or_zero(F.col("n"), F.col("total")))


def _series_rows(spark: SparkSession, d: str) -> DataFrame:
    mart = supply_by_category_year(spark, d)
    long = sample_marts.supply_series(mart, "supply_by_year", "all", "category")
    return V.series_rows(long, ["chart", "geo", "metric", "series"], "year", "value")


@query(f"""with {FILLED_SQL},
p as (select category as series, year, n, round_even(n::double / sum(n) over (partition by year) * 100.0, 2) as percent from filled),
l as (select series, year, 'counts' as metric, n::double as value from p
      union all select series, year, 'percentages', percent from p),
s as (
  select metric, series, '{{"x":["' || string_agg(year::varchar, '","' order by year) || '"],"y":['
         || string_agg(value::varchar, ',' order by year) || ']}}' as line
  from l group by metric, series),
m as (select metric, '"' || metric || '":{{' || string_agg('"' || series || '":' || line, ',' order by series) || '}}' as body
      from s group by metric)
select 'supply_by_year' as chart, 'all' as geo, '{{"data":{{' || string_agg(body, ',' order by metric) || '}}}}' as value from m""")
def series_document(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document with counts and percentages of every category."""
    return V.series_documents(_series_rows(spark, d))


@query(f"""with {FILLED_SQL},
p as (select category as series, year, n, round_even(n::double / sum(n) over (partition by year) * 100.0, 2) as percent from filled),
l as (select series, year, 'counts' as metric, n::double as value from p
      union all select series, year, 'percentages', percent from p)
select 'supply_by_year' as chart, 'all' as geo, metric, series,
       string_agg(year::varchar, ',' order by year) as x, string_agg(round(value)::bigint::varchar, ',' order by year) as y
from l group by metric, series""")
def series_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The arrays of the series document, written out as text."""
    whole = F.transform("y", lambda v: F.round(v).cast("bigint").cast("string"))
    return _series_rows(spark, d).select(
        "chart", "geo", "metric", "series", F.array_join("x", ",").alias("x"), F.array_join(whole, ",").alias("y")
    )


YEARS_SQL = ", ".join(f'sum(case when year = {y} then n end)::bigint as "{y}"' for y in range(1995, 2002))


@query(f"""{EARLY_SQL}
select series, {YEARS_SQL} from mart group by series union all select 'Total', {YEARS_SQL} from mart""")
def display_table_with_total(spark: SparkSession, d: str) -> DataFrame:
    return R.long_to_wide(_series_with_zeros(spark, d), "series", "year", "n", list(range(1995, 2002)), total="Total")
