"""Versioned tables by source and year: a version is written first, a pointer is switched last, readers go by the pointer.

``root/data/version=N/source=S/year=Y`` holds what the N-th publication wrote, ``root/pointer/generation=N`` names the
version that counts for each source and year since then. A publication that is broken off leaves files that no pointer
names; the next one writes over them. One publication runs at a time: the second of two at once fails when it switches.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

PARTS = ("source", "year")
POINTER = "source string, year int, version long, rows long, built_from long"
_DONE = re.compile(r"_done-(\d+)$")


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished publications."""
    files, path = _folder(spark, f"{root}/pointer")
    if not files.exists(path):
        return []
    names = [str(s.getPath().getName()) for s in files.listStatus(path)]
    return sorted(int(m[1]) for m in map(_DONE.match, names) if m)


def pointer(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    """The version that counts for each source and year: one small row for each, none before the first publication."""
    done = generations(spark, root)
    if generation is None and not done:
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).parquet(f"{root}/pointer/generation={done[-1] if generation is None else generation}")


def same_parts(left: DataFrame, right: DataFrame) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in PARTS])


def publish(df: DataFrame, root: str, built_from: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """Replace the sources and years that ``df`` holds by its rows, leave all others, and give the new generation.

    ``built_from`` (source, year, version) stamps what the rows were computed from; ``removed`` (source, year) names
    parts that are gone."""
    spark = df.sparkSession
    n = max(generations(spark, root), default=0) + 1
    target = f"{root}/data/version={n}"
    df.write.mode("overwrite").partitionBy(*PARTS).parquet(target)
    new = spark.read.schema(df.schema).parquet(target).groupBy(*PARTS).agg(F.count("*").alias("rows")).withColumn("version", F.lit(n).cast("long"))
    stamps = spark.createDataFrame([], "source string, year int, built_from long") if built_from is None else built_from.select(*PARTS, F.col("version").alias("built_from"))
    new = new.join(stamps, same_parts(new, stamps), "left").select(new["source"], new["year"], "version", "rows", "built_from")
    old = pointer(spark, root)
    kept = old.join(new, same_parts(old, new), "left_anti")
    if removed is not None:
        kept = kept.join(removed, same_parts(kept, removed), "left_anti")
    kept.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{root}/pointer/generation={n}")
    files, done = _folder(spark, f"{root}/pointer/_done-{n}")
    if not files.createNewFile(done):
        raise RuntimeError(f"{root}: generation {n} was published by another run meanwhile")
    return n


def _path(root: str, source: str, year: int | None, version: int) -> str:
    return f"{root}/data/version={version}/source={source}/year={'__HIVE_DEFAULT_PARTITION__' if year is None else year}"


def read(spark: SparkSession, root: str, schema: StructType, only: DataFrame | None = None) -> DataFrame:
    """The rows that count, or those of the pointer rows ``only``. A filter on source or year prunes folders.

    The pointer holds a row per source and year, as a listing of the folders would."""
    entries = pointer(spark, root) if only is None else only
    paths = [_path(root, r["source"], r["year"], r["version"]) for r in entries.select(*PARTS, "version").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    full = StructType([*[f for f in schema if f.name not in PARTS], *[StructField(f.name, f.dataType) for f in schema if f.name in PARTS]])
    return spark.read.schema(full).option("basePath", f"{root}/data").parquet(*paths).select(*schema.names)


def clean_up(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the data that none of the last ``keep`` generations names, and older pointers; gives the removed folders.

    Readers that hold an older generation lose it, so ``keep`` covers the longest reader."""
    done = generations(spark, root)
    named = {
        _path(root, r["source"], r["year"], r["version"])
        for n in done[-keep:] for r in pointer(spark, root, n).select(*PARTS, "version").collect()
    }
    removed = []
    for n in done:
        files, version = _folder(spark, f"{root}/data/version={n}")
        if not files.exists(version):
            continue
        for source in files.globStatus(_folder(spark, f"{root}/data/version={n}/source=*/year=*")[1]):
            path = source.getPath()
            own = f"{root}/data/version={n}/{path.getParent().getName()}/{path.getName()}"
            if own not in named:
                files.delete(path, True)
                removed.append(own)
    for n in done[:-keep]:
        # the mark goes first: a pointer without one counts for nobody
        for name in (f"_done-{n}", f"generation={n}"):
            files, path = _folder(spark, f"{root}/pointer/{name}")
            files.delete(path, True)
    return removed
