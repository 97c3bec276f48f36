"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import exact_dedup, language, lsh_forest, mixing, sentencepieces
from tallymark.llm.queries import tokenizer
from tallymark.llm.shared import keyed, small_batches, written

#: Predictions below this are rejected: neither the family nor the language is told apart.
LEAST_SCORE = 0.2
#: Points of the mix's schedule, of 256 words each, that one task writes.
STRETCH = 1 << 14


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; those without letters, or like no learned language, go."""
    small_batches(spark)
    fit = language.fitted(docs, language.remainder() != 0)
    # other columns travel under numbers, so that none is taken for one of the prediction's
    names = {c: c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)}
    numbered = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    kept = language.predicted(numbered, fit, keep=tuple(n for n in names.values() if n != "doc_id"))
    kept = kept.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def key_of(docs: DataFrame) -> str:
    """A name for the row key that no column has."""
    return next(n for n in (f"row_{k}" for k in range(len(docs.columns) + 1)) if n not in map(str.lower, docs.columns))


def staying(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    kept = found.filter("stays").select(F.col("row").alias("kept_row"))
    rows = docs.join(kept, docs[key] == kept["kept_row"], "left_semi")
    return rows.drop(key)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts, and one row of it if rows are repeated."""
    small_batches(spark)
    key = key_of(docs)
    docs = keyed(docs, key)
    return staying(docs, key, exact_dedup.duplicates(docs, row=key))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: the one that names it, and one row of it."""
    small_batches(spark)
    key = key_of(docs)
    docs = keyed(docs, key)
    return staying(docs, key, lsh_forest.join(docs, row=key))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share of words, in the order of the schedule: a row per round that takes some of a document,
    where its first block stands; the one that a round ends in is cut after its last word that the round takes.
    Documents without words have no share."""
    key, columns, schema = key_of(docs), docs.columns, docs.schema
    docs = keyed(docs, key)
    took = mixing.mixed(docs, row=key).filter("taken > 0")
    took = written(took.select(
        F.col("place").alias("took_row"), F.col("size").alias("took_size"), F.col("taken").alias("took_words"), F.col("first_position").alias("took_at"),
        F.col("start").alias("took_start"), F.col("points").alias("took_points"),
    ), "took")
    first = took.select("took_points").first()
    # stretches of equally many points: the schedule spreads sources evenly, so no sample of positions is needed
    stretches = max(1, (first["took_points"] if first else 0) // STRETCH)
    both = docs.join(took, docs[key] == took["took_row"])
    words = F.split(F.regexp_replace(docs["text"], r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(words, F.lit(1), took["took_words"].cast("int")), " ")
    changed = {"text": F.when(took["took_words"] < took["took_size"], cut).otherwise(docs["text"])}
    if "n_chars" in columns:
        changed["n_chars"] = F.length(changed["text"]).cast(schema["n_chars"].dataType)
    # other columns travel under numbers, so that none is taken for the place in the mix
    rows = both.select(*(changed.get(c, docs[f"`{c}`"]).alias(f"_{k}") for k, c in enumerate(columns)), took["took_at"].alias("at"), took["took_start"].alias("start"))
    stretch = F.expr(f"cast(at * {stretches} div {first['took_points'] if first else 1} as int)")
    rows = rows.repartitionById(stretches, stretch).sortWithinPartitions("at", "start")
    return rows.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(columns)))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the digest of the text that they decode to."""
    small_batches(spark)
    return sentencepieces.round_trip(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix), ("sentencepiece", pieces),
]

#: Neither a fitted classifier nor a piece search can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
