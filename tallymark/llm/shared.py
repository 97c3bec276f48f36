"""What the operators of this subpackage have in common: the shared folder, blanks, memory of workers, two-level running sums."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of the batches that go to Python workers, about, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only in local mode without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own[spark.sparkContext.applicationId] = named = "file://" + tempfile.mkdtemp(prefix="tallymark-")
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, cut from its lineage, safe from lost
    executors. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """The frame with a column `name` that tells each of its stored rows from all others, the same at every reading: the
    file and the place in it. A frame that is not just read from Parquet is written first."""
    plan = df._jdf.queryExecution().analyzed()
    stored = plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns
    if not (stored and "parquet" in plan.relation().toString().lower()):
        names = [f"_{k}" for k in range(len(df.columns))]
        df = written(df.toDF(*names), "rows").select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)), _place().alias(name))
        return df
    return df.select("*", _place().alias(name))


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch for Python workers, unless the session has a bound of its own: a batch of whole texts stands
    in the worker and, on its way there and back, in the executor."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on batches; the memory that it no longer needs goes back to the system when its task ends, as the worker
    lives on beside later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux") and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def running_sum(df: DataFrame, by: Sequence[str], chunk: str, order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """Sum of the value over the rows before each row of its group, in order; chunk is a column that rises with the order.

    A group is summed per chunk first, so that no task holds more than one chunk of it: chunks get the
    sums of those before them, rows the sums of those before them in their chunk."""
    df = df.withColumn("_value", value)
    sums = df.groupBy(*by, chunk).agg(F.sum("_value").alias("_sum"))
    sums = sums.select(
        *by, chunk,
        F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = F.sum("_value").over(Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    keys = [*by, chunk]
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), "_before")
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(sums[f"_{k}"])
    # rows that unfold from a small table look small to the optimizer: both sides are sorted, neither is sent to all tasks
    return df.join(sums.hint("merge"), same).withColumn(out, F.col("_before") + F.col("_inside")).drop("_value", "_before", "_inside", *(f"_{k}" for k in keys))
