"""Stand-ins for the landed tables, built from the given order tables.

Facts are reduced on their own keys before each join, so a customer, part or supplier that owns a
large part of all rows meets its dimension as a handful of counted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.operators.measures import tally
from tallymark.operators.select import in_year
from tallymark.plans.registry import table

SMALL = 5  # counts below this are printed as suppressed


def year(date: str) -> Column:
    return F.year(date).alias("year")


def sample_counts(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Samples per year and category (plus other part columns), from lineitem and part."""
    facts = tally(table(spark, d, "lineitem"), ["l_partkey", year("l_shipdate")])
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"), *extra)
    joined = facts.join(parts, facts.l_partkey == parts.p_partkey)
    return tally(joined, ["year", "category", *extra], "n")


def regional_sample_counts(spark: SparkSession, d: str, *extra: str, only: int | None = None) -> DataFrame:
    """Samples per region, year and category (plus other part columns); of one year by a range that reaches the scan."""
    keys = ["year", "category", *extra]
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"), *extra)
    lines = table(spark, d, "lineitem")
    lines = lines if only is None else lines.filter(in_year(F.col("l_shipdate"), only))
    facts = lines.select("l_partkey", "l_suppkey", year("l_shipdate"))
    typed = facts.join(parts, facts.l_partkey == parts.p_partkey)
    if extra:
        # names are too many for counts per supplier to be fewer than the rows themselves
        return _by_nation(spark, d, typed.select("l_suppkey", *keys, F.lit(1).cast("bigint").alias("n")), keys)
    return _by_nation(spark, d, tally(typed, ["l_suppkey", *keys]), keys)


def _by_nation(spark: SparkSession, d: str, by_supplier: DataFrame, keys: list[str]) -> DataFrame:
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    placed = by_supplier.join(suppliers, by_supplier.l_suppkey == suppliers.s_suppkey)
    by_key = tally(placed, ["s_nationkey", *keys], "n")
    nations = nation_names(spark, d)
    return by_key.join(nations, by_key.s_nationkey == nations.n_nationkey).select("geo", *keys, "n")


def supplier_year_counts(spark: SparkSession, d: str) -> DataFrame:
    """Line items per region and year."""
    facts = tally(table(spark, d, "lineitem"), ["l_suppkey", year("l_shipdate")])
    return _by_nation(spark, d, facts, ["year"])


def nation_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("geo"))


def monthly_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders per region, year, month and segment."""
    keys = ["year", "month"]
    facts = tally(
        table(spark, d, "orders"), ["o_custkey", year("o_orderdate"), F.month("o_orderdate").alias("month")]
    )
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("series"))
    placed = facts.join(customers, facts.o_custkey == customers.c_custkey)
    by_key = tally(placed, ["c_nationkey", *keys, "series"], "n")
    nations = nation_names(spark, d)
    return by_key.join(nations, by_key.c_nationkey == nations.n_nationkey).select("geo", *keys, "series", "n")


def yearly_orders(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    """Orders per region and year (and segment)."""
    return tally(monthly_orders(spark, d), ["geo", "year", *keys], "n")


def population(spark: SparkSession, d: str) -> DataFrame:
    """People per region and year: customers that ordered in the year.

    Customers are made distinct per year first, so the join and the final count see each once.
    """
    active = table(spark, d, "orders").select("o_custkey", year("o_orderdate")).distinct()
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    by_key = tally(active.join(customers, active.o_custkey == customers.c_custkey), ["c_nationkey", "year"])
    nations = nation_names(spark, d)
    return by_key.join(nations, by_key.c_nationkey == nations.n_nationkey).select(
        "geo", "year", F.col("n").alias("population")
    )


def printed(n: str = "n") -> Column:
    """A count as a publisher prints it."""
    return F.when(F.col(n) < SMALL, "Suppr.").otherwise(F.col(n).cast("string"))


# The same stand-ins as SQL, for the reference queries -------------------------------

SAMPLES_SQL = """samples as (
  select year(l_shipdate)::integer as year, p_type as category, p_name, n_name as geo,
         l_returnflag = 'R' as fentanyl_pos, l_linestatus = 'F' as benzo_pos
  from lineitem join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""

MONTHLY_SQL = """monthly as (
  select n_name as geo, year(o_orderdate)::integer as year, month(o_orderdate)::integer as month,
         c_mktsegment as series, count(*)::bigint as n
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by all)"""

POPULATION_SQL = """population as (
  select n_name as geo, year(o_orderdate)::integer as year, count(distinct o_custkey)::bigint as population
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by all)"""
