"""Every registered query runs and equals its reference SQL on the smallest tables."""

import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_names_only_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_no_row_pairs(spark):
    """No query multiplies rows by a cross join, even where nothing is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, job in contract.queries().items():
            plan = job(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
