"""Plain-format readers with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallymark.sources.landing import catalogue, latest_path, name_fields


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header that must agree with the schema; splits and pruning are left to the scan."""
    return (
        spark.read.schema(schema)
        .option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST")
        .csv(path)
    )


def read_landed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV files of the landing zone, every row with the source key and dates of its file's name."""
    rows = read_csv(spark, path, schema)
    fields = name_fields(F.col("_metadata.file_name"))
    return rows.select("*", *[fields[n].alias(n) for n in ("source", "as_of", "data_until")])


def read_latest_csv(spark: SparkSession, root: str, source: str, schema: StructType) -> DataFrame:
    """Newest version of one source; older versions are not opened."""
    return read_landed_csv(spark, latest_path(catalogue(spark, root), source), schema)


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Landed API answers: JSON records, one per line or as one array; files of both layouts may lie together.

    A file is line-delimited if each of its lines is an object. Such files are split among tasks."""
    line = F.trim("value")
    layout = (
        spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line")).filter("line <> ''")
        .groupBy("file").agg(F.min(F.col("line").startswith("{") & F.col("line").endswith("}")).alias("lines"))
    )
    files = {lines: [r["file"] for r in layout.filter(F.col("lines") == lines).collect()] for lines in (True, False)}
    reader = spark.read.schema(schema)
    rows = [reader.option("multiLine", str(not lines)).json(found) for lines, found in files.items() if found]
    return reduce(DataFrame.unionAll, rows) if rows else spark.createDataFrame([], schema)


def read_region_map(spark: SparkSession, path: str) -> DataFrame:
    """``{authority: [locations]}`` to ``(location, authority, position)`` in file order."""
    text = spark.read.option("wholetext", "true").text(path)
    parsed = text.select(F.from_json("value", "map<string,array<string>>").alias("m"))
    authorities = parsed.select(F.posexplode(F.map_entries("m")).alias("position", "entry"))
    return authorities.select(
        F.explode("entry.value").alias("location"), F.col("entry.key").alias("authority"), "position"
    ).dropDuplicates(["location", "authority"])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Named map features of GeoJSON files; geometry is not read."""
    schema = "features array<struct<properties: struct<ENGNAME: string>>>"
    docs = spark.read.schema(schema).option("multiLine", "true").json(path)
    return docs.select(F.explode("features").alias("f")).select(F.col("f.properties.ENGNAME").alias("ENGNAME"))


def read_series_documents(spark: SparkSession, path: str) -> DataFrame:
    """Published chart documents back to series rows."""
    schema = "data map<string, map<string, struct<x: array<string>, y: array<double>>>>"
    docs = spark.read.option("basePath", path).text(path)
    parsed = docs.select(
        *[c for c in docs.columns if c != "value"], F.from_json("value", schema).alias("doc")
    )
    keys = [c for c in parsed.columns if c != "doc"]
    metrics = parsed.select(*keys, F.explode("doc.data").alias("metric", "lines"))
    series = metrics.select(*keys, "metric", F.explode("lines").alias("series", "line"))
    return series.select(*keys, "metric", "series", "line.x", "line.y")


def series_points(rows: DataFrame) -> DataFrame:
    """Series rows to one row per point."""
    keys = [c for c in rows.columns if c not in ("x", "y")]
    return rows.select(*keys, F.inline(F.arrays_zip("x", "y")))
