"""The queries of this subpackage: each operator over its whole table, and the digests that their results carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import (
    collocations, exact_dedup, filter_audit, html_text, language, lsh_forest, mixing, perspectives, quartile_digest, secret_scan, sentencepieces, sql,
    superminhash, token_blocks,
)
from tallymark.plans.registry import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each text, and the text that they decode to as a digest."""
    path = tokenizer("piece_bpe_32k.model")
    return sentencepieces.round_trip(table(spark, folder, "documents"), path)


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(kind) for kind, *_ in secret_scan.BASE), F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op4_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return token_blocks.checked(token_blocks.write(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json")))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extracted(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives.rotated(table(spark, folder, "conversations"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fit = language.fitted(docs, language.remainder() != 0)
    return language.predicted(docs, fit).select("doc_id", (language.remainder() == 0).alias("held_out"), "lang_pred", "score")


def op8_quartile_digest(spark: SparkSession, folder: str) -> DataFrame:
    return quartile_digest.with_next(table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of each document over all rounds, and where in the mix they stand (-1: nowhere)."""
    took = mixing.mixed(table(spark, folder, "documents"))
    by_row = took.groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.sum("taken").alias("taken"), F.sum("slots").alias("slots"), *(F.coalesce(f(c), F.lit(-1)).alias(c) for f, c in ((F.min, "first_position"), (F.max, "last_position"))),
    )
    return by_row.drop("row")


def op10_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.join(table(spark, folder, "documents"))


def op11_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, folder, "documents")), table(spark, folder, "labels"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_sentencepiece, op3_secret_scan, op4_token_blocks, op5_html_text, op6_perspectives, op7_language,
        op8_quartile_digest, op9_mixing, op10_lsh_forest, op11_superminhash, op12_filter_audit, op13_collocations, pipeline,
    )
}
SQL = dict(sql.SQL)
