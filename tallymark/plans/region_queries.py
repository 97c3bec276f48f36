"""Queries over dimensions: regions, titles, codes, sources, saved visuals and metric choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.functions.text import relabel
from tallymark.operators import measures as M, regions as G, reshape as R, select as S
from tallymark.operators.ordered import first_match
from tallymark.plans import harm_marts, standins
from tallymark.plans.registry import query, table
from tallymark.plans.settle import settled
from tallymark.plans.standins import MONTHLY_SQL

REGION_MAP_SQL = """region_map as (
  select n_name as location, r_name as authority, r_regionkey::bigint as position
  from nation join region on n_regionkey = r_regionkey where n_nationkey % 6 <> 5
  union all select n_name, 'ELSEWHERE', 99 from nation where n_nationkey % 6 = 1)"""

PLACES_SQL = """places as (
  select n_name as location, year(l_shipdate)::integer as year, count(*)::bigint as n
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all
  union all
  select 'Total', year(l_shipdate)::integer, count(*)::bigint from lineitem group by all)"""


def _region_map(spark: SparkSession, d: str) -> DataFrame:
    """Nation to region; some nations are not listed, some are listed twice."""
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    listed = nations.join(regions, nations.n_regionkey == regions.r_regionkey).filter("n_nationkey % 6 <> 5").select(
        F.col("n_name").alias("location"), F.col("r_name").alias("authority"), F.col("r_regionkey").cast("bigint").alias("position")
    )
    again = nations.filter("n_nationkey % 6 = 1").select(
        F.col("n_name").alias("location"), F.lit("ELSEWHERE").alias("authority"), F.lit(99).cast("bigint").alias("position")
    )
    return R.stack_rows(listed, again)


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Line items per nation and year with the printed total row."""
    by_nation = settled(standins.supplier_year_counts(spark, d)).withColumnRenamed("geo", "location")
    total = M.tally(by_nation, ["year"], "n").withColumn("location", F.lit("Total"))
    return R.stack_rows(by_nation, total)


@query(f"""with {REGION_MAP_SQL}, {PLACES_SQL},
one as (select location, arg_min(authority, position) as authority from region_map group by location)
select case when authority is not null then authority when lower(location) = 'total' then 'Whole' else 'Unknown' end as authority,
       year, sum(n)::bigint as n
from places left join one using (location) group by 1, 2""")
def region_totals_with_unknown(spark: SparkSession, d: str) -> DataFrame:
    return G.totals_by_authority(_places(spark, d), _region_map(spark, d), "n", ["year"], whole="Whole")


@query(f"""with {REGION_MAP_SQL}
select location, arg_min(authority, position) as authority from region_map group by location""")
def first_listed_authority(spark: SparkSession, d: str) -> DataFrame:
    return first_match(_region_map(spark, d), "location", "authority", "position")


@query(f"""with {PLACES_SQL}
select location as geo, year, n from places where location in (select n_name from nation where n_nationkey % 3 = 0)""")
def matched_features(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("ENGNAME"))
    return G.match_features(_places(spark, d).withColumnRenamed("location", "geo"), features).select("geo", "year", "n")


@query("""select n_name as geo from nation where n_name not in (
  select n_name from nation join supplier on s_nationkey = n_nationkey where s_acctbal > 9000)""")
def unmatched_regions(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return G.without_match(table(spark, d, "nation"), rich, ["n_nationkey"]).select(F.col("n_name").alias("geo"))


@query("""select p_partkey, p_name from part
where lower(replace(split_part(p_name, ',', 1), ' ', '')) in ('redplate', 'smallwidget')""")
def title_lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    terms = ["Red Plate, per 100,000", "small  WIDGET"]
    return S.lookup_titles(table(spark, d, "part"), "p_name", terms, exact=True).select("p_partkey", "p_name")


@query("""select p_partkey, p_name from part
where contains(lower(replace(p_name, ' ', '')), 'tring') or contains(lower(replace(p_name, ' ', '')), 'hotr')""")
def title_lookup_contains(spark: SparkSession, d: str) -> DataFrame:
    return S.lookup_titles(table(spark, d, "part"), "p_name", ["T Ring", "Hot R"]).select("p_partkey", "p_name")


@query("""select p_partkey, p_name from part
where contains(lower(p_name), 'hot') and not contains(lower(p_name), 'ring')""")
def yearly_title_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tables found by title without their monthly twins (titles with ``ring`` stand for those)."""
    found = S.lookup_titles(table(spark, d, "part"), "p_name", ["hot"])
    titled = found.withColumn("title", F.replace("p_name", F.lit("ring"), F.lit("Monthly")))
    return S.yearly_tables(titled, "title").select("p_partkey", "p_name")


@query("""select p_partkey, p_type from part where p_type in (
  select p_type from part group by p_type having max(p_retailprice) >= (select max(p_retailprice) from part) - 1)""")
def enabled_titles(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose title is switched on in a title table (here: types that hold a top price)."""
    parts = table(spark, d, "part")
    top = parts.agg(F.max("p_retailprice")).scalar()
    titles = parts.groupBy("p_type").agg((F.max("p_retailprice") >= top - 1).alias("enabled"))
    return S.enabled_only(parts, titles, "p_type").select("p_partkey", "p_type")


@query("""select year(o_orderdate)::integer as year, o_orderpriority as series, count(*)::bigint as n
from orders where o_orderdate >= timestamp '1997-01-01' and o_orderstatus = 'F'
  and left(o_orderpriority, 1) in ('1', '4') group by all""")
def code_list_filter(spark: SparkSession, d: str) -> DataFrame:
    orders = S.slice_indicator(table(spark, d, "orders").filter(S.since_year(F.col("o_orderdate"), 1997)), o_orderstatus="F")
    labelled = orders.select(
        standins.year("o_orderdate"), F.col("o_orderpriority").alias("series"),
        F.concat(F.lit("Priority ["), F.substring("o_orderpriority", 1, 1), F.lit("]")).alias("violation"),
    )
    kept = S.from_year(labelled, "year", 1997).filter(S.has_code(F.col("violation"), ("1", "4")))
    return M.tally(kept, ["year", "series"])


@query(f"""with {MONTHLY_SQL}
select geo as region, year, sum(n)::bigint as n from monthly
where series = 'MACHINERY' and geo in ('NATION_1', 'NATION_2', 'NATION_9') group by all""")
def indicator_slice(spark: SparkSession, d: str) -> DataFrame:
    sliced = S.slice_indicator(
        standins.monthly_orders(spark, d), series="MACHINERY", geo=["NATION_1", "NATION_2", "NATION_9"]
    )
    return M.tally(sliced, ["geo", "year"], "n").withColumnRenamed("geo", "region")


@query("""with t as (
  select n_name || ' Health Authority: ' || case when l_linestatus = 'F' then 'Sex-Specific Deaths' else 'Death Rates' end as title,
         year(l_shipdate)::integer as year, l_returnflag as label, count(*)::bigint as n
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all)
select replace(split_part(title, ':', 1), ' Health Authority', '') as geo, year, lower(label) as series,
       case when contains(title, 'Rates') then 'rates' else 'counts' end as metric, n::double as value
from t where not starts_with(title, 'NATION_1 ')""")
def sex_split_title(spark: SparkSession, d: str) -> DataFrame:
    facts = M.tally(
        table(spark, d, "lineitem"),
        ["l_suppkey", standins.year("l_shipdate"), F.col("l_returnflag").alias("label"), "l_linestatus"],
    )
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    by_key = M.tally(facts.join(suppliers, facts.l_suppkey == suppliers.s_suppkey), ["s_nationkey", "year", "label", "l_linestatus"], "n")
    nations = standins.nation_names(spark, d)
    named = by_key.join(nations, by_key.s_nationkey == nations.n_nationkey)
    measure = F.when(F.col("l_linestatus") == "F", "Sex-Specific Deaths").otherwise("Death Rates")
    tables = named.select(
        F.concat("geo", F.lit(" Health Authority: "), measure).alias("title"), "year", "label",
        F.col("n").cast("string").alias("raw_value"),
    )
    return harm_marts.sex_by_authority(tables, whole="NATION_1")


@query("""select n_name as geo,
       case n_name when 'NATION_0' then 'n0' when 'NATION_1' then 'n1' else n_name end as code, count(*)::bigint as n
from customer join nation on c_nationkey = n_nationkey group by all""")
def region_codes(spark: SparkSession, d: str) -> DataFrame:
    by_key = M.tally(table(spark, d, "customer"), ["c_nationkey"])
    nations = standins.nation_names(spark, d)
    named = by_key.join(nations, by_key.c_nationkey == nations.n_nationkey).select("geo", "n")
    return named.withColumn("code", relabel(F.col("geo"), {"NATION_0": "n0", "NATION_1": "n1"}))


SOURCE_CATALOGUE_SQL = """source_catalogue as (
  select event_type as source, max(ts)::date as as_of, max(case when value > 10 then ts end)::date as data_until
  from events group by all)"""


def _source_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(
        F.to_date(F.max("ts")).alias("as_of"), F.to_date(F.max(F.when(F.col("value") > 10, F.col("ts")))).alias("data_until")
    )


@query(f"""with {SOURCE_CATALOGUE_SQL},
daily as (select event_type as source, ts::date as day, count(*)::bigint as n from events group by all)
select source, day, n, as_of, data_until from daily left join source_catalogue using (source)""")
def chart_source_dates(spark: SparkSession, d: str) -> DataFrame:
    daily = M.tally(table(spark, d, "events"), [F.col("event_type").alias("source"), F.to_date("ts").alias("day")])
    return G.attach_source(daily, _source_catalogue(spark, d))


@query("""select event_type as name, max(ts::date) as as_of, max(ts::date) as data_until from events group by all""")
def source_list(spark: SparkSession, d: str) -> DataFrame:
    """Every source once, whatever number of charts names it."""
    day = F.to_date("ts")
    used = table(spark, d, "events").select(F.col("event_type").alias("name"), day.alias("as_of"), day.alias("data_until"))
    return G.source_list(used)


@query("""select distinct c_mktsegment as series, c_nationkey as region from customer""")
def distinct_series(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").withColumnsRenamed({"c_mktsegment": "series", "c_nationkey": "region"})
    return M.distinct_values(named, "series", "region")


VISUALS_SQL = """filters as (
  select n_nationkey as visual_id, 'geo' as filter_type, n_name as filter_value from nation
  union all select n_nationkey, 'series', case when n_nationkey % 4 = 0 then 'BUILDING' else 'MACHINERY' end from nation where n_nationkey % 2 = 0
  union all select n_nationkey, 'year', (1995 + n_nationkey % 7)::varchar from nation where n_nationkey % 3 = 0
  union all select n_nationkey, 'year', '1900' from nation where n_nationkey % 9 = 0)"""


@query(f"""with {MONTHLY_SQL}, {VISUALS_SQL},
points as (select geo || '/' || series || '/' || year as point_id, geo, series, year, sum(n) as n from monthly group by all),
wanted as (select visual_id, count(*) as n from filters group by all)
select w.visual_id, p.point_id from points p join filters f
  on (f.filter_type = 'geo' and f.filter_value = p.geo) or (f.filter_type = 'series' and f.filter_value = p.series)
  or (f.filter_type = 'year' and f.filter_value = p.year::varchar)
join wanted w on w.visual_id = f.visual_id
group by w.visual_id, p.point_id, w.n having count(*) = w.n""")
def saved_visual_query(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")

    def rows(condition: str, kind: str, value) -> DataFrame:
        return nations.filter(condition).select(
            F.col("n_nationkey").alias("visual_id"), F.lit(kind).alias("filter_type"), value.alias("filter_value")
        )

    filters = R.stack_rows(
        rows("true", "geo", F.col("n_name")),
        rows("n_nationkey % 2 = 0", "series", F.when(F.expr("n_nationkey % 4 = 0"), "BUILDING").otherwise("MACHINERY")),
        rows("n_nationkey % 3 = 0", "year", F.expr("cast(1995 + n_nationkey % 7 as string)")),
        rows("n_nationkey % 9 = 0", "year", F.lit("1900")),
    )
    points = standins.yearly_orders(spark, d, "series").withColumn("point_id", F.concat_ws("/", "geo", "series", "year"))
    return S.match_saved_visuals(points, filters, ["geo", "series", "year"], "point_id")


METRICS_SQL = f"""with {MONTHLY_SQL},
y as (select geo, year, sum(n)::bigint as n from monthly group by all),
m as (select geo, year, 'percentages' as metric, n * 1.0::double as value from y
      union all select geo, year, 'rates', n * 2.0::double from y where geo <> 'NATION_2'
      union all select geo, year, 'counts', n * 3.0::double from y where geo not in ('NATION_2', 'NATION_4'))"""


@query(f"""{METRICS_SQL},
o as (select *, case metric when 'counts' then 1 when 'rates' then 2 else 3 end as pos from m),
b as (select geo, min(pos) as pos from o group by geo)
select geo, year, metric, value from o join b using (geo, pos)""")
def metric_fallback(spark: SparkSession, d: str) -> DataFrame:
    yearly = settled(standins.yearly_orders(spark, d))
    geo, n = F.col("geo"), F.col("n").cast("double")
    offered = F.array(
        F.struct(F.lit("percentages").alias("metric"), n.alias("value")),
        F.when(geo != "NATION_2", F.struct(F.lit("rates").alias("metric"), (n * 2.0).alias("value"))),
        F.when(~geo.isin("NATION_2", "NATION_4"), F.struct(F.lit("counts").alias("metric"), (n * 3.0).alias("value"))),
    )
    metrics = yearly.select("geo", "year", F.inline(F.array_compact(offered)))
    return S.preferred_metric(metrics, ["geo"])
