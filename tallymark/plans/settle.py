"""Reduced frames that several branches of a job use are computed once.

Spark can reuse an exchange only between branches that read exactly the same columns, and column
pruning often makes them differ. A frame that stands for a pass over the facts and is needed more
than once is therefore checkpointed: small, in the folder all executors share, without lineage back
to the facts.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """Materialise a reduced frame. Only for frames that are small next to what they were made from."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, for a table that a job writes and reads again; it goes when the driver ends."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame next to the checkpoints and read it back: computed once, and of a size that the optimizer knows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallymark-")
    context.setCheckpointDir(named)
