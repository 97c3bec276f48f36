"""Term sets as tables: which of many terms a text contains.

Terms and texts meet in an index of character grams. Of each term only its rarest gram is looked up, as a text that
contains the term contains that gram; the pairs found so are then tested exactly. No text is compared with all terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions import numbers as N
from tallymark.operators.groups import join_groups
from tallymark.plans.settle import stored

GRAM = 5


def grams(text: Column, length: int) -> Column:
    """Distinct runs of so many characters; none of a shorter text. One pass, whatever the length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def same_text(text: str) -> Column:
    """A digest that stands for a text, so that the text itself need not be moved or compared."""
    return F.unhex(F.sha2(F.col(text), 256))


def mentions_of(texts: DataFrame, terms: DataFrame, text: str, term: str, gram: int = GRAM) -> DataFrame:
    """One row per distinct text and distinct term in it, character by character: (key, text, term), key the text's digest.

    A reader that does not need the text leaves it out, so that it is moved once and not once per term in it."""
    distinct = stored(texts.select(F.col(text).alias("text")).filter("text is not null").distinct().withColumn("key", same_text("text")), "texts")
    wanted = terms.select(F.col(term).alias("term")).filter("term is not null").distinct()
    # terms with their grams are stored, as are the distinct texts and the rarest grams: read back, Spark knows their size, and
    # where terms are few it tests the grams of the texts where they arise, without moving them
    own = F.when(F.length("term") <= gram, F.array("term")).otherwise(grams(F.col("term"), gram))
    asked = stored(wanted.select("term", F.explode(own).alias("gram")), "asked")
    # texts offer grams of the lengths that terms ask for: at most gram + 1 different ones
    lengths = sorted(r["n"] for r in asked.select(F.length("gram").alias("n")).distinct().collect())
    offered = [grams(F.col("text"), n) if n else F.array(F.lit("")) for n in lengths] or [F.array().cast("array<string>")]
    index = distinct.select("key", F.explode(F.concat(*offered)).alias("gram"))
    # grams of terms with the number of texts that have them; a gram of no text rules its term out
    counted = index.select("gram").join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = asked.join(counted, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("_rarest"))
    rarest = stored(rarest.filter("_rarest.texts > 0").select("term", F.col("_rarest.gram").alias("gram")), "rarest")
    candidates = index.join(rarest, "gram").select("key", "term")
    return distinct.join(candidates, "key").filter(F.contains("text", "term")).select("key", "text", "term")
def contained_terms(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", gram: int = GRAM) -> DataFrame:
    """Pairs (text, term) of the distinct texts and terms where the text contains the term, character by character.

    Terms shorter than a gram are looked up whole; an empty term is in every text. NULL texts and terms have no pairs."""
    return mentions_of(texts, terms, text, term, gram).select("text", "term")


def titled(df: DataFrame, terms: DataFrame, title: str, term: str = "term", exact: bool = False) -> DataFrame:
    """Rows whose title equals, or contains, one of the terms of a table."""
    if exact:
        return df.join(terms.select(F.col(term).alias("_term")).distinct(), F.col(title) == F.col("_term"), "left_semi")
    found = mentions_of(df, terms, title, term).select(F.col("key").alias("_key")).distinct()
    return df.join(found, same_text(title) == F.col("_key"), "left_semi")


def term_counts(df: DataFrame, by: Sequence[str], terms: DataFrame, text: str, term: str = "term") -> DataFrame:
    """Rows per group that mention each term of a table, with their share of the group's rows: (by, term, n, total, percent).

    Terms that a group never mentions have no row. Equal texts are counted before they meet the terms."""
    counts = df.groupBy(*by, same_text(text).alias("_key")).agg(F.count("*").alias("_rows"))
    found = mentions_of(df, terms, text, term).select(F.col("key").alias("_key"), "term")
    mentions = counts.join(found, "_key").groupBy(*by, "term").agg(F.sum("_rows").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("_rows").alias("total"))
    return join_groups(mentions, totals, by).withColumn("percent", N.percent_or_zero(F.col("n"), F.col("total")))
