"""The keyed stream: copies, restarts, landings in several files, forgetting."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymark.streaming import counted
from tallymark.streaming.counted import load_counted

DDL = "name string, day date, at timestamp, x double"
ROWS = [
    ("a", "2024-01-01", "2024-01-01 10:00:00.123456", 0.1), ("a", "2024-01-01", "2024-01-01 10:00:00.123456", 0.1), ("b", None, None, None),
    (None, None, None, 1e-17), ('q"uote, é', "2024-01-02", "2024-01-02 00:00:00", -0.0),
]


@pytest.fixture
def feed(spark, tmp_path):
    schema = StructType.fromDDL(DDL)

    class Feed:
        def land(self, version, rows, part=0):
            df = spark.createDataFrame([tuple(r) for r in rows], "name string, day string, at string, x double")
            df = df.select("name", F.col("day").cast("date").alias("day"), F.col("at").cast("timestamp").alias("at"), "x")
            df.coalesce(1).write.parquet(str(tmp_path / f"landing-{version}-{part}"))

        def run(self, **options):
            version = F.date_add(F.lit("2024-01-01").cast("date"), F.regexp_extract(F.col("_metadata.file_path"), r"/landing-(\d+)-", 1).cast("int"))
            load_counted(spark, str(tmp_path / "landing-*"), schema, str(tmp_path / "store"), str(tmp_path / "state"), "parquet", version, **options).awaitTermination()

        def stored(self):
            rows = spark.read.schema(StructType.fromDDL(DDL)).parquet(str(tmp_path / "store")).select("name", F.col("day").cast("string"), F.col("at").cast("string"), "x")
            return Counter(tuple(r) for r in rows.collect())


    return Feed()


def times(rows, *counts):
    return Counter({tuple(r): n for r, n in zip(rows, counts, strict=True) if n})


def plain(rows):
    # a whole second prints without its fraction
    return [rows[0], *rows[2:]]


def test_copies_of_all_landings(feed):
    feed.land(1, ROWS)
    feed.run()
    assert feed.stored() == times(plain(ROWS), 2, 1, 1, 1)
    # the stored rows come again; some have more copies, some fewer, one is new
    new = ("new", "2024-01-03", "2024-01-03 00:00:00", 2.0)
    feed.land(2, [ROWS[0], ROWS[2], ROWS[2], ROWS[3], new])
    feed.run()
    assert feed.stored() == times([*plain(ROWS), new], 2, 2, 1, 1, 1)
    feed.run()  # nothing has landed
    assert sum(feed.stored().values()) == 7


def test_a_landing_in_several_batches(feed):
    """Parts of one landing add up, whatever batch they come in."""
    for part in range(3):
        feed.land(1, [ROWS[0], ROWS[2]], part)
    feed.land(2, [ROWS[0]] * 2, 0)
    feed.run(files_per_batch=1)
    assert feed.stored() == times([ROWS[0], ROWS[2]], 3, 3)


def test_a_hot_record_is_combined_before_it_is_dealt():
    import pandas as pd

    part = pd.DataFrame({"record": ["r"] * 5000 + ["s"], "landed": ["1"] * 2500 + ["2"] * 2501, "n": [1] * 5001})
    out = next(counted.combined(iter([part])))
    assert sorted(map(tuple, out.to_numpy().tolist())) == [("r", "1", 2500), ("r", "2", 2500), ("s", "2", 1)]


def test_records_are_forgotten_after_their_time(feed):
    """A record that no landing held for long is dropped from the state; those seen since are known."""
    feed.land(1, [ROWS[0], ROWS[3]])
    feed.run(forgotten="30 days")
    feed.land(20, [ROWS[3]])
    feed.run(forgotten="30 days")
    feed.land(45, [ROWS[3]])
    feed.run(forgotten="30 days")
    feed.land(46, [ROWS[0], ROWS[3]])
    feed.run(forgotten="30 days")
    assert feed.stored() == times([ROWS[0], ROWS[3]], 2, 1)


def test_records_of_a_share_go_together(feed):
    """Records that share an entry of the state are counted and forgotten one by one."""
    feed.land(1, [ROWS[0], ROWS[0], ROWS[2], ROWS[3]])
    feed.run(forgotten="30 days", shares=1)
    feed.land(20, [ROWS[3], ROWS[3], ROWS[2]])
    feed.run(forgotten="30 days", shares=1)
    assert feed.stored() == times(plain(ROWS)[:3], 2, 1, 2)
    feed.land(45, [ROWS[3]])
    feed.run(forgotten="30 days", shares=1)
    feed.land(46, [ROWS[0], ROWS[2], ROWS[3]])
    feed.run(forgotten="30 days", shares=1)
    assert feed.stored() == times(plain(ROWS)[:3], 3, 1, 2)


def test_one_call_for_all_records_of_a_share():
    import pandas as pd

    class State:
        exists, kept = False, None

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            self.at = at

    state = State()
    part = pd.DataFrame({"record": ["a", "b", "a"], "ms": [5, 7, 9], "n": [2, 1, 3]})
    out = list(counted.surplus((0,), iter([part]), state))
    assert [tuple(sorted(zip(x["record"], x["copies"], strict=True))) for x in out] == [(("a", 3), ("b", 1))] and state.at == 8
    assert list(counted.surplus((0,), iter([part.head(1)]), state))[0].to_numpy().tolist() == [["a", 1]]
