"""File-source stream for a feed that is landed again and again with mostly known rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallymark.operators.incremental import new_rows
from tallymark.sources.landing import name_fields
from tallymark.sources.sinks import replace_partitions


def checkpoint_root(spark: SparkSession, default: str) -> str:
    """The shared folder the cluster names; ``default`` only where none is set."""
    return spark.conf.get("spark.checkpoint.dir", None) or default


def load_feed(
    spark: SparkSession, landing: str, schema: StructType, store: str, date: str, checkpoint: str,
    fmt: str = "csv",
) -> StreamingQuery:
    """Read what has landed since the last run, append only the rows that are new, and stop.

    Every micro-batch writes its own ``batch`` partition and compares with the other ones, so a batch
    that is repeated after a failure replaces itself and the store never holds a row too often.
    """
    stream = (
        spark.readStream.schema(schema).format(fmt).option("header", "true").load(landing)
        .withColumn("version", name_fields(F.col("_metadata.file_name"))["as_of"])
    )
    columns = schema.names

    def append(batch: DataFrame, batch_id: int) -> None:
        stored = _stored(batch.sparkSession, store, schema).filter(F.col("batch") != batch_id).select(*columns)
        fresh = new_rows(batch, stored, date, version="version")
        replace_partitions(fresh.withColumn("batch", F.lit(batch_id)), store, ["batch"])

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", os.path.join(checkpoint, "feed"))
        .trigger(availableNow=True)
        .start()
    )


def _stored(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The store as it is; an empty one before the first batch."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(store)
