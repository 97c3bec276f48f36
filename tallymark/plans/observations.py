"""The canonical observation table: every feed yields the same checked shape, marts read it pruned by source and year.

Marts over it are kept as partial sums per source and year, so a refresh recomputes only what was published since.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.functions import numbers as N
from tallymark.functions.text import clean_label
from tallymark.schemas import OBSERVATION, PARTIALS
from tallymark.sources import versions

PERIODS = ("year", "quarter", "month", "day", "all")
NEEDED = ("source", "geo_type", "geo", "period_type", "series", "metric", "is_suppressed", "as_of")


def observations(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    """Rows in the canonical shape. Fields not given are NULL; from ``raw_value`` come, unless given, the typed value and
    the suppression flag. Rows that break the shape fail the job (see :func:`checked`)."""
    names = [f.name for f in OBSERVATION]
    unknown = set(fields) - set(names)
    if unknown or not re_name(source):
        raise ValueError(f"not fields of an observation: {sorted(unknown)}" if unknown else f"not a source name: {source}")
    fields = {"source": F.lit(source), "is_suppressed": F.lit(False), **fields}
    if "raw_value" in fields:
        raw = fields["raw_value"]
        given = {"value": N.to_number(raw), "is_suppressed": N.is_suppressed(raw)}
        fields = {**fields, **{k: v for k, v in given.items() if k == "is_suppressed" or k not in fields}, "raw_value": clean_label(raw)}
    typed = [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATION]
    return checked(df.select(*typed))


def re_name(source: str) -> bool:
    """Source names are those of landed files, and safe as the name of a folder."""
    return source.isascii() and source.replace("_", "").replace("-", "").isalnum()


def checked(df: DataFrame) -> DataFrame:
    """The same rows; one that lacks a needed field, has an unknown period type, a month that is none or is missing,
    or a value although it is suppressed, fails the job with its faults."""
    faults = {f"no {c}": F.col(c).isNull() for c in NEEDED}
    faults["period_type"] = ~F.col("period_type").isin(*PERIODS)
    faults["month"] = ~F.col("month").between(1, 12) | (F.col("month").isNull() & (F.col("period_type") == "month"))
    faults["value of a suppressed cell"] = F.col("is_suppressed") & F.col("value").isNotNull()
    found = F.concat_ws(", ", *[F.when(wrong, name) for name, wrong in faults.items()])
    row = F.to_json(F.struct(*[f.name for f in OBSERVATION]))
    return df.withColumn("source", F.when(found == "", F.col("source")).otherwise(F.raise_error(F.concat(F.lit("observation: "), found, F.lit(" "), row))))


# Producers -------------------------------------------------------------------------


def indicator_observations(ind: DataFrame, as_of: Column, data_until: Column | None = None, source: str = "nationalHarms") -> DataFrame:
    """Typed indicator rows (:func:`tallymark.plans.harm_marts.typed_indicators`)."""
    return observations(
        ind, source, geo_type=F.lit("region"), geo=F.col("geo"), year=F.col("year"), as_of=as_of, data_until=_or_null(data_until),
        period_type=F.when(F.lower("period_type").contains("quarter"), "quarter").otherwise("year"),
        series=F.concat_ws(": ", "event", "substance", "measure", "series"), metric=F.lower("unit"), raw_value=F.col("raw_value"),
    )


def population_observations(people: DataFrame, as_of: Column, source: str = "population") -> DataFrame:
    return observations(
        people, source, geo_type=F.lit("region"), geo=F.col("geo"), year=F.col("year"), period_type=F.lit("year"), as_of=as_of,
        series=F.lit("population"), metric=F.lit("people"), raw_value=F.col("population").cast("string"), value=F.col("population"),
    )


def offence_observations(rows: DataFrame, as_of: Column, source: str = "drugOffences") -> DataFrame:
    """Police statistics (:func:`tallymark.plans.feeds.drug_offences`)."""
    return observations(
        rows, source, geo_type=F.lit("region"), geo=F.col("geo"), year=F.col("year"), period_type=F.lit("year"), as_of=as_of,
        series=F.col("series"), metric=F.col("metric"), raw_value=F.col("raw_value"),
    )


def month_observations(rows: DataFrame, as_of: Column, name: str = "series", geo: Column | None = None, source: str = "monthlyWorkbook") -> DataFrame:
    """Monthly workbook rows (:func:`tallymark.plans.feeds.provincial_months`, ``unit_months`` with ``name="unit"``)."""
    unit = name == "unit"
    return observations(
        rows, source, geo_type=F.lit("health_unit" if unit else "province"), geo=F.col("unit") if unit else F.lit("Ontario") if geo is None else geo,
        year=F.col("year"), month=F.col("month"), period_type=F.lit("month"), as_of=as_of, series=F.lit("all drugs") if unit else F.col(name),
        metric=F.lit("deaths"), raw_value=F.col("raw_value"),
    )


def dashboard_observations(rows: DataFrame, as_of: Column, source: str = "coronerDashboards") -> DataFrame:
    """Dashboard cells (:func:`tallymark.plans.feeds.dashboard_tables`): the title leads with the region."""
    return observations(
        rows, source, geo_type=F.lit("dashboard"), geo=F.trim(F.split_part("title", F.lit(":"), F.lit(1))), year=F.col("year"),
        period_type=F.when(F.col("year").isNull(), "all").otherwise("year"), as_of=as_of, series=F.concat_ws(": ", "title", "label"),
        metric=F.col("header"), raw_value=F.col("raw_value"),
    )


def fatality_observations(rows: DataFrame, value: str, as_of: Column, geo: str, source: str = "monthlyFatalities") -> DataFrame:
    """Monthly fatalities (:func:`tallymark.plans.feeds.fatalities`)."""
    return observations(
        rows, source, geo_type=F.lit("province"), geo=F.lit(geo), year=F.year("month_start"), month=F.month("month_start"),
        period_type=F.lit("month"), as_of=as_of, series=F.col("drug_type"), metric=F.lit("deaths"), raw_value=F.col(value).cast("string"),
    )


def sample_observations(samples: DataFrame, as_of: Column, source: str = "drugChecks") -> DataFrame:
    """Drug-check samples, counted per region, month and category; samples without a date count in no period of their own."""
    counted = samples.groupBy("geo", "year", F.month("visit_date").alias("month"), "category").agg(F.count("*").alias("n"))
    return observations(
        counted, source, geo_type=F.lit("health_authority"), geo=F.coalesce("geo", F.lit("Unknown")), year=F.col("year"), month=F.col("month"),
        period_type=F.when(F.col("month").isNull(), "all").otherwise("month"), as_of=as_of, series=F.coalesce("category", F.lit("Unknown")),
        metric=F.lit("samples"), raw_value=F.col("n").cast("string"), value=F.col("n"),
    )


def _or_null(column: Column | None) -> Column:
    return F.lit(None) if column is None else column


# Store -----------------------------------------------------------------------------


def publish(df: DataFrame, root: str) -> int:
    """Replace the sources and years of ``df`` in the table; the version that readers see is switched last."""
    if df.schema.names != OBSERVATION.names:
        raise ValueError("not observations")
    return versions.publish(df, root)


def stored(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, root, OBSERVATION)


def sliced(spark: SparkSession, root: str, source: str, since: int | None = None, until: int | None = None, **dims: str) -> DataFrame:
    """Observations of one source and some years: other folders are not opened."""
    kept = F.col("source") == source
    for bound, fits in ((since, F.col("year") >= since), (until, F.col("year") <= until)):
        kept = kept & fits if bound is not None else kept
    rows = stored(spark, root).filter(kept)
    for name, wanted in dims.items():
        rows = rows.filter(F.col(name) == wanted)
    return rows


# Marts that are refreshed by what changed ---------------------------------------------

KEYS = ("geo_type", "geo", "series", "metric")


def partials(obs: DataFrame) -> DataFrame:
    """Sums of the observations of each source and year that can be added up later."""
    return obs.groupBy("source", "year", *KEYS).agg(
        F.sum("value").alias("total"), F.count("value").alias("n"), F.count_if("is_suppressed").alias("suppressed"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"), F.max("as_of").alias("as_of"),
    ).select(*PARTIALS.names)


def added_up(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sums to the mart of the given keys; the mean is of the published values."""
    sums = parts.groupBy(*keys).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("suppressed").alias("suppressed"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.max("as_of").alias("as_of"),
    )
    return sums.withColumn("mean", F.try_divide("total", "n"))


def changed(spark: SparkSession, table: str, mart: str) -> DataFrame:
    """Pointer rows of the table whose version the mart was not built from."""
    now, built = versions.pointer(spark, table), versions.pointer(spark, mart)
    return now.join(built, versions.same_parts(now, built) & (now["version"] == built["built_from"]), "left_anti")


def refresh(spark: SparkSession, table: str, mart: str) -> DataFrame:
    """Bring a mart's partial sums up to date: only sources and years published since are read and replaced.

    Gives the pointer rows that were read. A refresh that is broken off is repeated by the next one."""
    fresh = changed(spark, table, mart)
    now, built = versions.pointer(spark, table), versions.pointer(spark, mart)
    gone = built.join(now, versions.same_parts(built, now), "left_anti").select(*versions.PARTS)
    if fresh.isEmpty() and gone.isEmpty():
        return fresh
    versions.publish(partials(versions.read(spark, table, OBSERVATION, fresh)), mart, fresh, gone)
    return fresh


def mart_rows(spark: SparkSession, mart: str, keys: Sequence[str] = ("source", "year", *KEYS)) -> DataFrame:
    return added_up(versions.read(spark, mart, PARTIALS), keys)
