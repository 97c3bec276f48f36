"""Writers. Partitions are replaced as a whole, so a repeated run leaves the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.operators.ordered import newest_row


def write_version(df: DataFrame, path: str, source: str, as_of: str, data_until: str, fmt: str = "parquet") -> None:
    """One version of a source under ``source=/as_of=/data_until=``; the version is replaced if it exists."""
    stamped = df.withColumns({"source": F.lit(source), "as_of": F.lit(as_of), "data_until": F.lit(data_until)})
    replace_partitions(stamped, path, ["source", "as_of", "data_until"], fmt)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> None:
    """Overwrite exactly the partitions that occur in ``df``.

    A partition is written by as many tasks as hold rows of it; nothing is shuffled to one writer.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def write_workbook(tables: DataFrame, path: str) -> None:
    """Several sheets as one dataset, a partition per sheet."""
    replace_partitions(tables, path, ["sheet"])


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON text, a directory per chart and region; other regions' documents stay."""
    replace_partitions(documents.select("chart", "geo", "value"), path, ["chart", "geo"], "text")


def write_observations(df: DataFrame, path: str) -> None:
    replace_partitions(df, path, ["source", "as_of"])


def latest_version(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Rows of a source's newest version; only that version's partition is scanned."""
    stored = spark.read.parquet(path).filter(F.col("source") == source)
    order = [c for c in ("as_of", "data_until") if c in stored.columns]
    newest = stored.agg(F.max(F.struct(*order))).scalar()
    for c in order:
        stored = stored.filter(F.col(c).eqNullSafe(newest[c]))
    return stored


def retained_versions(versions: DataFrame) -> DataFrame:
    """The versions to keep when older ones are cleaned up: the newest per source."""
    return newest_row(versions, ["source"], ["as_of", "data_until"])
