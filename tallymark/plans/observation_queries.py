"""Queries over the canonical observation table, built from the order tables as two feeds that publish again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.operators import measures as M
from tallymark.plans import observations as O, standins
from tallymark.plans.registry import query, table
from tallymark.plans.settle import scratch
from tallymark.sources import versions

# Orders come first in full, then again from the last two years on, scraped a year later and with doubled counts.
OBSERVED_SQL = f"""{standins.MONTHLY_SQL}, {standins.SAMPLES_SQL},
ends as (select max(year)::integer - 1 as recent, (max(year) || '-12-31')::date as as_of from monthly),
printed as (select geo, year, month, series, year >= recent as again, case when year >= recent then 2 * n else n end as n, as_of from monthly cross join ends),
observed as (
  select 'orders' as source, 'nation' as geo_type, geo, 'month' as period_type, year, month, series, 'orders' as metric,
         case when n < {standins.SMALL} then 'Suppr.' else n::varchar end as raw_value, case when n >= {standins.SMALL} then n::double end as value,
         n < {standins.SMALL} as is_suppressed, case when again then (as_of + interval 1 year)::date else as_of end as as_of, as_of as data_until
  from printed
  union all
  select 'samples', 'nation', geo, 'year', year, null, category, 'samples', count(*)::varchar, count(*)::double, false, max(as_of), null
  from samples cross join ends group by geo, year, category)"""


def _orders(spark: SparkSession, d: str, times: int, since_recent: bool) -> DataFrame:
    monthly = standins.monthly_orders(spark, d)
    last = table(spark, d, "orders").agg(F.year(F.max("o_orderdate"))).scalar()
    if since_recent:
        monthly = monthly.filter(F.col("year") >= last - 1)
    until = F.make_date(last, F.lit(12), F.lit(31))
    return O.observations(
        monthly.withColumn("n", F.col("n") * times), "orders", geo_type=F.lit("nation"), geo=F.col("geo"), period_type=F.lit("month"), year=F.col("year"),
        month=F.col("month"), series=F.col("series"), metric=F.lit("orders"), raw_value=standins.printed(),
        as_of=F.add_months(until, 12 if since_recent else 0), data_until=until,
    )


def _samples(spark: SparkSession, d: str) -> DataFrame:
    counts = M.tally(standins.regional_sample_counts(spark, d), ["geo", "year", "category"], "n", "n")
    until = F.make_date(table(spark, d, "orders").agg(F.year(F.max("o_orderdate"))).scalar(), F.lit(12), F.lit(31))
    return O.observations(
        counts, "samples", geo_type=F.lit("nation"), geo=F.col("geo"), period_type=F.lit("year"), year=F.col("year"), series=F.col("category"),
        metric=F.lit("samples"), raw_value=F.col("n").cast("string"), as_of=until,
    )


def published(spark: SparkSession, d: str, between=lambda root: None) -> str:
    """The table after both feeds and the second, shorter landing of the orders."""
    root = scratch(spark, "observations")
    O.publish(_orders(spark, d, 1, False), root)
    O.publish(_samples(spark, d), root)
    between(root)
    O.publish(_orders(spark, d, 2, True), root)
    return root


@query(f"with {OBSERVED_SQL} select * from observed")
def observation_table(spark: SparkSession, d: str) -> DataFrame:
    """Both feeds in the canonical shape; a later landing replaced its own years only."""
    return O.stored(spark, published(spark, d))


@query(f"""with {OBSERVED_SQL}
select geo, series, count(value)::bigint as months, sum(value) as total, count(*) filter (is_suppressed)::bigint as suppressed
from observed where source = 'orders' and year between 1996 and 1999 group by geo, series""")
def observation_slice(spark: SparkSession, d: str) -> DataFrame:
    """A mart of one source and some years: other folders are pruned."""
    rows = O.sliced(spark, published(spark, d), "orders", 1996, 1999)
    return rows.groupBy("geo", "series").agg(F.count("value").alias("months"), F.sum("value").alias("total"), F.count_if("is_suppressed").alias("suppressed"))


@query(f"""with {OBSERVED_SQL}
select geo_type, geo, series, metric, sum(value) as total, count(value)::bigint as n, count(*) filter (is_suppressed)::bigint as suppressed,
       min(value) as lowest, max(value) as highest, max(as_of) as as_of, sum(value) / nullif(count(value), 0) as mean
from observed group by geo_type, geo, series, metric""")
def observation_mart_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """A mart that was built before the second landing and refreshed after it, from the years that changed."""
    mart = scratch(spark, "mart")
    root = published(spark, d, lambda table: O.refresh(spark, table, mart))
    O.refresh(spark, root, mart)
    return O.mart_rows(spark, mart, O.KEYS)


@query(f"""with {OBSERVED_SQL}
select source, year, case when source = 'samples' then 2 when year >= recent then 3 else 1 end::bigint as version, count(*)::bigint as rows
from observed cross join ends group by all""")
def observation_versions(spark: SparkSession, d: str) -> DataFrame:
    """Which publication counts for each source and year, after old data was cleaned up."""
    root = published(spark, d)
    versions.clean_up(spark, root, keep=1)
    return versions.pointer(spark, root).select("source", "year", "version", "rows")
