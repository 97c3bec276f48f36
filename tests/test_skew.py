"""The same queries where one key, source or record holds a third of all rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallymark.operators import ordered
from tallymark.plans import standins
from tallymark.plans.catalog import QUERIES, SQL

from test_queries import FOLDER, TABLES, plain, pytestmark  # noqa: F401

SKEWED = (
    "supply_by_category_year", "regional_supply_rollup", "token_frequency", "region_totals_with_unknown", "sex_split_title",
    "rate_per_100k_same_year", "suppressed_year_totals", "saved_visual_query", "mart_percent_count_rate", "forward_fill",
    "trimmed_rows", "latest_per_source", "newest_row_per_source", "incremental_overlap", "chart_source_dates",
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    hot = {
        "lineitem": "* replace (case when l_orderkey % 3 = 0 then 7 else l_partkey end as l_partkey, case when l_orderkey % 3 = 0 then 3 else l_suppkey end as l_suppkey)",
        "orders": "* replace (case when o_orderkey % 3 = 0 then 1 else o_custkey end as o_custkey)",
        "events": "* replace (case when event_id % 3 = 0 then 5 else user_id end as user_id, case when event_id % 3 = 0 then 'click' else event_type end as event_type, case when event_id % 3 = 0 then timestamp '2024-01-25 01:00:00' else ts end as ts)",
        "conversations": "case when conv_id % 3 = 0 then 0 else conv_id end as conv_id, (row_number() over (partition by case when conv_id % 3 = 0 then 0 else conv_id end order by conv_id, turn) - 1)::bigint as turn, role, text",
    }
    for name in TABLES:
        source = f"select {hot.get(name, '*')} from '{FOLDER}/{name}.parquet'"
        con.execute(f"copy ({source}) to '{target}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{target}/{name}.parquet'")
    return str(target), con


@pytest.mark.parametrize("name", SKEWED)
def test_skewed(spark, folder, name, monkeypatch):
    path, con = folder
    # small blocks, so that the hot table is really cut
    for scan in ("carry_forward", "running_total"):
        defaults = getattr(ordered, scan).__defaults__
        monkeypatch.setattr(getattr(ordered, scan), "__defaults__", tuple(8 if d == ordered.BLOCK_ROWS else d for d in defaults))
    df = QUERIES[name](spark, path)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_hot_part_is_split_in_the_join(spark, folder):
    """The join of raw facts with their dimension splits the partition of a hot key."""
    path, _ = folder
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "20KB", "spark.sql.files.openCostInBytes": "0",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        wide = path + "/wide.parquet"
        spark.read.parquet(f"{path}/lineitem.parquet").repartition(8).write.mode("overwrite").parquet(wide)
        facts = spark.read.parquet(wide).select("l_partkey", "l_suppkey", standins.year("l_shipdate"))
        parts = spark.read.parquet(f"{path}/part.parquet").select("p_partkey", "p_type")
        df = facts.join(parts, facts.l_partkey == parts.p_partkey).groupBy("l_suppkey", "year", "p_type").agg(F.count("*"))
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
