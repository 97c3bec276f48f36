"""A feed landed in slices that overlap, loaded by the keyed stream in two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.plans.registry import query, table
from tallymark.plans.settle import scratch
from tallymark.streaming.counted import load_counted

# Three landings of the events: the first days; the days after two weeks with some records twice; the same with others twice.
SLICES_SQL = """ends as (select min(ts)::date as first from events),
slices as (
  select unnest(case when ts::date < first + 14 then ['1'] when ts::date < first + 19 then ['1', '2', '3'] else ['2', '3'] end) as version,
         event_type, user_id, ts::date as day, event_id
  from events cross join ends),
landed as (
  select version, event_type, user_id, day,
         case when (version = '2' and event_id % 20 = 0) or (version = '3' and event_id % 10 < 2) then 2 else 1 end as copies
  from slices)"""


def _landings(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", F.to_date("ts").alias("day"))
    first = events.agg(F.min("day")).scalar()
    late, early = F.col("day") >= F.date_add(first, 14), F.col("day") < F.date_add(first, 19)
    slices = events.withColumn("version", F.explode(F.array_compact(F.array(F.when(early, "1"), F.when(late, "2"), F.when(late, "3")))))
    twice = ((F.col("version") == "2") & (F.col("event_id") % 20 == 0)) | ((F.col("version") == "3") & (F.col("event_id") % 10 < 2))
    return slices.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.when(twice, 2).otherwise(1)))).drop("_copy", "event_id")


def _landed() -> Column:
    return F.concat(F.lit("2024-01-0"), F.regexp_extract(F.col("_metadata.file_path"), r"/landing-(\d+)/", 1)).cast("date")


@query(f"""with {SLICES_SQL},
counted as (select version, event_type, user_id, day, sum(copies) as n from landed group by all)
select event_type, user_id, day, max(n)::bigint as copies from counted group by event_type, user_id, day""")
def feed_counted_by_state(spark: SparkSession, d: str) -> DataFrame:
    """Each record as often as in the landing with most copies of it; the second run goes on from the checkpoint."""
    root = scratch(spark, "feed")
    landings = _landings(spark, d)
    schema = landings.drop("version").schema

    def run(*versions: str) -> None:
        for version in versions:
            landings.filter(F.col("version") == version).drop("version").write.parquet(f"{root}/landing-{version}")
        load_counted(spark, f"{root}/landing-*", schema, f"{root}/store", f"{root}/state", "parquet", _landed()).awaitTermination()

    run("1")
    run("2", "3")
    stored = spark.read.parquet(f"{root}/store")
    return stored.groupBy("event_type", "user_id", "day").agg(F.count("*").alias("copies"))
