"""Queries over the event feed: landed names, freshness, incremental loads; and cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.functions import periods as P
from tallymark.operators import incremental as I, measures as M, ordered as O, reshape as R
from tallymark.plans import standins
from tallymark.plans.registry import query, table
from tallymark.sources import landing, workbooks
from tallymark.sources.sinks import retained_versions


@query("""select event_id, event_type, ts from events
qualify ts::date = max(ts::date) over (partition by event_type)""")
def latest_per_source(spark: SparkSession, d: str) -> DataFrame:
    """All rows of each source's newest day."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts", F.to_date("ts").alias("day"))
    return O.latest_rows(events, ["event_type"], "day").drop("day")


@query("""select event_type as source, arg_max(event_id, (ts, event_id)) as event_id, max(ts::date) as as_of
from events group by all""")
def newest_row_per_source(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_type").alias("source"), "event_id", "ts", F.to_date("ts").alias("as_of"))
    return O.newest_row(events, ["source"], ["ts", "event_id"]).drop("ts")


@query("""select event_id, event_type, ts from events order by ts desc, event_id desc limit 5""")
def newest_five_rows(spark: SparkSession, d: str) -> DataFrame:
    """Head of the stored feed, newest first, as a re-read is compared with it."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return O.first_rows(events, [F.desc("ts"), F.desc("event_id")])


NAMES_SQL = """names as (
  select strftime(ts, '%Y%m%d') || case event_type when 'click' then '_' || strftime(ts - interval 5 day, '%Y%m')
           when 'view' then '_' || strftime(ts - interval 3 day, '%Y%m%d') else '' end || '_' || event_type ||
         case when user_id % 10 = 0 then '.xlsx' else '.csv' end as file_name
  from events
  union all select 'notes-' || event_type || '.txt' from events)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    """File names as they would be landed, one or more per event day and type, and foreign ones."""
    events = table(spark, d, "events")
    until = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("_"), F.date_format(F.expr("ts - interval 5 days"), "yyyyMM")))
        .when(F.col("event_type") == "view", F.concat(F.lit("_"), F.date_format(F.expr("ts - interval 3 days"), "yyyyMMdd")))
        .otherwise("")
    )
    suffix = F.when(F.col("user_id") % 10 == 0, ".xlsx").otherwise(".csv")
    named = F.concat(F.date_format("ts", "yyyyMMdd"), until, F.lit("_"), "event_type", suffix)
    foreign = F.concat(F.lit("notes-"), "event_type", F.lit(".txt"))
    return R.stack_rows(events.select(named.alias("file_name")), events.select(foreign.alias("file_name"))).distinct()


FILES_SQL = f"""{NAMES_SQL},
files as (
  select distinct file_name, regexp_extract(file_name, '_([a-z]+)\\.', 1) as source,
         strptime(left(file_name, 8), '%Y%m%d')::date as as_of,
         case when regexp_matches(file_name, '^\\d{{8}}_\\d{{8}}_') then strptime(substr(file_name, 10, 8), '%Y%m%d')::date
              when regexp_matches(file_name, '^\\d{{8}}_\\d{{6}}_') then strptime(substr(file_name, 10, 6) || '01', '%Y%m%d')::date
              else strptime(left(file_name, 8), '%Y%m%d')::date end as data_until,
         regexp_extract(file_name, '\\.([a-z]+)$', 1) as format
  from names where regexp_matches(file_name, '^\\d{{8}}'))"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    named = _names(spark, d).withColumns(landing.name_fields(F.col("file_name")))
    return named.filter("source is not null and as_of is not null")


@query(f"with {FILES_SQL} select * from files")
def landed_names(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)


@query(f"""with {FILES_SQL}
select source, as_of, data_until from (select distinct source, as_of, data_until from files)
qualify row_number() over (partition by source order by as_of desc, data_until desc) = 1""")
def retained_versions_per_source(spark: SparkSession, d: str) -> DataFrame:
    return retained_versions(_files(spark, d).select("source", "as_of", "data_until"))


@query(f"""with {FILES_SQL},
wanted as (select distinct role as source from conversations union select distinct event_type from events)
select source from wanted where source not in (select source from files)""")
def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    wanted = R.stack_rows(
        table(spark, d, "conversations").select(F.col("role").alias("source")),
        table(spark, d, "events").select(F.col("event_type").alias("source")),
    )
    return landing.missing_sources(_files(spark, d), wanted)


@query(f"""with {FILES_SQL}, wanted as (select distinct event_type as source from events where event_type < 'f')
select file_name, source from files where source in (select source from wanted)""")
def existing_sources(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "events").filter("event_type < 'f'").select(F.col("event_type").alias("source"))
    return landing.existing_sources(_files(spark, d), wanted).select("file_name", "source")


@query(f"""with {FILES_SQL},
l as (select source, max(as_of) as as_of from files group by all),
s as (select event_type as source, max(ts)::date - case when event_type < 'f' then 1 else 0 end as as_of from events where event_type <> 'view' group by event_type)
select l.source, l.as_of from l left join s using (source) where s.as_of is null or l.as_of > s.as_of""")
def newer_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources to replace: not stored yet, or stored with an earlier scrape date."""
    landed = _files(spark, d).groupBy("source").agg(F.max("as_of").alias("as_of"))
    stored = table(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("source")).agg(
        F.to_date(F.max("ts")).alias("_last")
    )
    lag = F.when(F.col("source") < "f", 1).otherwise(0)
    return I.newer_sources(landed, stored.select("source", F.date_sub("_last", lag).alias("as_of")))


@query("""with d as (select event_type as source, count(distinct ts::date)::bigint as counted from events group by all),
e as (select event_type as source, case when event_type = 'view' then 0 else date_diff('day', min(ts)::date, max(ts)::date) + 1 end::bigint as expected
      from events where event_type <> 'error' group by event_type)
select source, counted, expected from d full join e using (source) where counted is distinct from expected""")
def shape_drift(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose number of landed days differs from the expected number."""
    events = table(spark, d, "events")
    days = events.select(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).distinct()
    span = F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1
    expected = events.filter("event_type <> 'error'").groupBy(F.col("event_type").alias("source")).agg(span.alias("_days"))
    return I.shape_drift(
        M.tally(days, ["source"], name="counted"),
        expected.select("source", F.when(F.col("source") == "view", 0).otherwise(F.col("_days")).cast("bigint").alias("expected")),
    )


@query("""select max(ts::date) as data_until,
       (make_date(year(max(ts)), 1, 1) + to_months((3 * quarter(max(ts)))::integer))::date as quarter_until,
       max(ts) filter (event_type = 'purchase') as last_purchase
from events""")
def data_until(spark: SparkSession, d: str) -> DataFrame:
    """How far the feed reaches: last day, first day after its last quarter, last row of one series."""
    events = table(spark, d, "events")
    label = F.concat_ws(" Q", F.year("ts"), F.quarter("ts"))
    return events.agg(
        F.max(F.to_date("ts")).alias("data_until"), F.max(P.quarter_data_until(label)).alias("quarter_until"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_purchase"),
    )


@query("""with stored as (select event_type, user_id, ts::date as day from events where ts < timestamp '2024-01-20'
  union all select event_type, user_id, ts::date from events where ts < timestamp '2024-01-20' and event_id % 50 = 0),
feed as (select event_type, user_id, ts::date as day from events where ts >= timestamp '2024-01-15'
  union all select event_type, user_id, ts::date from events where ts >= timestamp '2024-01-15' and event_id % 20 = 0)
select * from feed except all select * from stored where day >= (select min(day) from feed)""")
def incremental_overlap(spark: SparkSession, d: str) -> DataFrame:
    """New rows of a feed that repeats stored days; copies on both sides count."""
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts", F.to_date("ts").alias("day"))

    def with_copies(rows: DataFrame, copies: str) -> DataFrame:
        times = F.array_repeat(F.lit(1), F.when(F.expr(copies), 2).otherwise(1))
        return rows.select("event_type", "user_id", "day", F.explode(times).alias("_copy")).drop("_copy")

    stored = with_copies(events.filter("ts < timestamp '2024-01-20'"), "event_id % 50 = 0")
    feed = with_copies(events.filter("ts >= timestamp '2024-01-15'"), "event_id % 20 = 0")
    return I.new_rows(feed, stored, date="day")


@query("""with stored as (select case when event_type <> 'error' then ts::date end as day, event_type, user_id from events where ts < timestamp '2024-01-20'),
feed as (select case when event_type <> 'error' then ts::date end as day, event_type, user_id from events where ts >= timestamp '2024-01-15')
select * from feed except all select * from stored""")
def incremental_undated(spark: SparkSession, d: str) -> DataFrame:
    """New rows of a feed in which some rows have no date: stored ones are known again."""
    day = F.when(F.col("event_type") != "error", F.to_date("ts")).alias("day")
    events = table(spark, d, "events")
    stored = events.filter("ts < timestamp '2024-01-20'").select(day, "event_type", "user_id")
    return I.new_rows(events.filter("ts >= timestamp '2024-01-15'").select(day, "event_type", "user_id"), stored, date="day")


@query("""select year(l_shipdate)::integer as year, l_returnflag as series, count(*)::bigint as n from lineitem group by all""")
def year_replace_without_feed(spark: SparkSession, d: str) -> DataFrame:
    """An empty feed leaves the stored years as they are."""
    stored = M.tally(table(spark, d, "lineitem"), [standins.year("l_shipdate"), F.col("l_returnflag").alias("series")])
    return I.replace_from_year(stored, stored.filter("false"), "year")


@query("""with landed as (select event_type as source, max(ts)::date + 1 as as_of, max(ts)::date as data_until from events group by event_type),
stored as (select source, as_of - 1 as as_of, case when source < 'f' then data_until else data_until - 1 end as data_until from landed where source <> 'view')
select l.* from landed l left join stored s using (source) where s.source is null or (l.as_of > s.as_of and l.data_until is distinct from s.data_until)""")
def newer_data_only(spark: SparkSession, d: str) -> DataFrame:
    """A later scrape of data that ends on the same day is skipped."""
    landed = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(
        F.date_add(F.to_date(F.max("ts")), 1).alias("as_of"), F.to_date(F.max("ts")).alias("data_until")
    )
    lag = F.when(F.col("source") < "f", 0).otherwise(1)
    stored = landed.filter("source <> 'view'").select("source", F.date_sub("as_of", 1).alias("as_of"), F.date_sub("data_until", lag).alias("data_until"))
    return I.newer_sources(landed, stored, end="data_until")


@query("""with stored as (select year(l_shipdate)::integer as year, l_returnflag as series, count(*)::bigint as n from lineitem where l_shipdate < timestamp '2000-01-01' group by all),
feed as (select year(l_shipdate)::integer as year, l_returnflag as series, count(*)::bigint * 2 as n from lineitem where l_shipdate >= timestamp '1998-01-01' group by all)
select * from stored where year < (select min(year) from feed) union all select * from feed""")
def year_bounded_replace(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")

    def yearly(rows: DataFrame) -> DataFrame:
        return M.tally(rows, [standins.year("l_shipdate"), F.col("l_returnflag").alias("series")])

    stored = yearly(lines.filter("l_shipdate < timestamp '2000-01-01'"))
    feed = yearly(lines.filter("l_shipdate >= timestamp '1998-01-01'")).withColumn("n", F.col("n") * 2)
    return I.replace_from_year(stored, feed, "year")


# Cell tables: suppliers as sheets per nation ------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """One sheet per supplier nation: a header row, then one row per supplier with three columns."""
    suppliers = table(spark, d, "supplier")
    sheet = F.concat(F.lit("sheet "), F.col("s_nationkey")).alias("sheet")
    body = suppliers.select(
        F.lit("book").alias("path"), sheet, (F.col("s_suppkey") + 1).cast("int").alias("row_no"),
        F.posexplode(F.array(
            F.col("s_suppkey").cast("string"), F.col("s_name"),
            F.when(F.col("s_suppkey") % 7 > 0, F.floor("s_acctbal").cast("string")),
        )).alias("col_no", "value"),
    ).filter("value is not null")
    header = suppliers.select("s_nationkey").distinct().select(
        F.lit("book").alias("path"), sheet, F.lit(0).alias("row_no"),
        F.posexplode(F.array(F.lit("Unnamed: 0"), F.lit("Name"), F.lit("Balance"))).alias("col_no", "value"),
    )
    return R.stack_rows(header, body)


@query("""select distinct 'book' as path, 'sheet ' || s_nationkey as sheet, 'Name' as title from supplier""")
def sheet_titles(spark: SparkSession, d: str) -> DataFrame:
    return workbooks.sheet_titles(_cells(spark, d))


@query("""select 'book' as path, 'sheet ' || s_nationkey as sheet, s_suppkey::integer as row_no, s_name as "Name",
       case when s_suppkey % 7 > 0 then floor(s_acctbal)::bigint::varchar end as "Balance"
from supplier""")
def promoted_headers(spark: SparkSession, d: str) -> DataFrame:
    headed = workbooks.promote_header(_cells(spark, d))
    return workbooks.cells_to_table(workbooks.drop_columns(headed, 0), ["Name", "Balance"])


CELLS_SQL = """cells as (
  select 'book' as path, 'sheet ' || s_nationkey as sheet, s_suppkey::integer + 1 as row_no, unnest([0, 1, 2]) as col_no,
         unnest([s_suppkey::varchar, s_name, case when s_suppkey % 7 > 0 then floor(s_acctbal)::bigint::varchar end]) as value
  from supplier
  union all select distinct 'book', 'sheet ' || s_nationkey, 0, c.col_no, c.value
  from supplier cross join (select unnest([0, 1, 2]) as col_no, unnest(['Unnamed: 0', 'Name', 'Balance']) as value) c)"""


@query(f"""with {CELLS_SQL}
select sheet, row_no, col_no, value from cells where row_no = 0 or (row_no - 1) % 7 > 0""")
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    return workbooks.complete_rows(_cells(spark, d)).select("sheet", "row_no", "col_no", "value")


@query(f"""with {CELLS_SQL}
select path, sheet, col_no as row_no, row_no as col_no, value from cells where value is not null""")
def transposed_cells(spark: SparkSession, d: str) -> DataFrame:
    return R.transpose_cells(_cells(spark, d))


@query("select s_acctbal, s_suppkey, s_nationkey from supplier")
def last_column_first(spark: SparkSession, d: str) -> DataFrame:
    return R.last_column_first(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
