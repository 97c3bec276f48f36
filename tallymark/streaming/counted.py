"""A feed that is landed again and again, with the copies of each record kept in the stream's state.

The store is never read again: the state knows per record how many copies are stored and how many each landing had. It is
checkpointed with the stream, so a run that was broken off goes on where it stopped.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tallymark.operators.incremental import repeat_rows
from tallymark.sources.landing import name_fields
from tallymark.sources.sinks import replace_partitions

#: Records are carried as text, exact to the microsecond.
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
FORGOTTEN = "400 days"
#: Records are kept and compared a share at a time: a call of Python per record costs far more than its comparison.
SHARES = 1 << 12


def combined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies of a record in one landing become one counted row before they are dealt by record."""
    for part in parts:
        yield part.groupby(["record", "landed"], as_index=False).agg(n=("n", "sum"))


def surplus(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Copies of a share's records beyond those stored: a record counts as often as in the landing that has most copies of it."""
    # per record: copies stored, copies per landing
    known = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
    landed_now = set()
    for part in parts:
        for record, landed, n in zip(part["record"].tolist(), part["ms"].tolist(), part["n"].tolist(), strict=True):
            seen = known.setdefault(record, [0, {}])[1]
            seen[str(landed)] = seen.get(str(landed), 0) + n
            landed_now.add(record)
    new = {}
    for record in landed_now:
        stored, seen = known[record]
        most = max(seen.values())
        if most > stored:
            new[record], known[record][0] = most - stored, most
    # the watermark runs behind the newest landing: once it is past the record's last one, the record is forgotten
    past = state.getCurrentWatermarkMs()
    ends = {record: max(map(int, seen)) + 1 for record, (_, seen) in known.items()}
    known = {record: held for record, held in known.items() if ends[record] >= past or record in landed_now}
    if known:
        state.update((zlib.compress(json.dumps(known).encode(), 1),))
        state.setTimeoutTimestamp(max(past, min(ends[record] for record in known)))
    else:
        state.remove()
    if new:
        yield pd.DataFrame({"record": list(new), "copies": list(new.values())})


def counted(stream: DataFrame, landed: str = "landed", forgotten: str = FORGOTTEN, shares: int = SHARES) -> DataFrame:
    """New copies of the records of a stream: (record as JSON, copies).

    ``landed`` holds the day of a row's landing, which may come in several files and batches. A record that was not
    landed again within ``forgotten`` before the newest landing is forgotten and would count as new again; a landing that
    much older than the newest one is late and not read. A row without a landing fails the job. Records are dealt to so many
    ``shares``, each one entry of the state; the number must stay the same as long as the checkpoint is used."""
    columns = [c for c in stream.columns if c != landed]
    day = F.coalesce(F.col(landed).cast("timestamp"), F.raise_error(F.lit("a row without the day of its landing")))
    rows = stream.select(F.to_json(F.struct(*columns), JSON).alias("record"), day.alias("landed"), F.lit(1).cast("long").alias("n"))
    rows = rows.mapInPandas(combined, "record string, landed timestamp, n long").withWatermark("landed", forgotten)
    shared = rows.withColumn("ms", F.unix_millis("landed")).withColumn("share", F.pmod(F.xxhash64("record"), F.lit(shares)))
    return shared.groupBy("share").applyInPandasWithState(
        surplus, "record string, copies long", "records binary", "update", GroupStateTimeout.EventTimeTimeout
    )


def load_counted(
    spark: SparkSession, landing: str, schema: StructType, store: str, checkpoint: str, fmt: str = "csv", landed: Column | None = None,
    files_per_batch: int = 1000, forgotten: str = FORGOTTEN, shares: int = SHARES,
) -> StreamingQuery:
    """Read what has landed since the last run, append the copies that are new, and stop.

    ``landed`` is the day of a row's landing, by default the date in its file's name. ``checkpoint`` is a folder that all executors
    share. Each micro-batch writes its own ``batch`` partition of the store, so a repeated one replaces itself. The first
    run starts with an empty store: rows stored before are landed first, as a landing of their own."""
    landed = name_fields(F.col("_metadata.file_name"))["as_of"] if landed is None else landed
    stream = (
        spark.readStream.schema(schema).format(fmt).option("header", "true").option("maxFilesPerTrigger", files_per_batch).load(landing)
        .select(*[F.col(f"`{c}`") for c in schema.names], landed.alias("_landed"))
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.from_json("record", schema, JSON).alias("row"), "copies").select("row.*", "copies")
        replace_partitions(repeat_rows(rows, "copies").withColumn("batch", F.lit(batch_id)), store, ["batch"])

    return (
        counted(stream, "_landed", forgotten, shares).writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
