"""Mix sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled and laid end to end, and cut into blocks of equal words; its target fills so many
slots. Slot j of all slots, source after source, stands at the point whose van der Corput place is j: reversing the
bits of j gives its position in the mix. So the points 0, 1/2, 1/4, 3/4, ... fall into the cumulative shares of the
sources, any stretch of the mix has each source close to its share, and every source gets exactly its slots. Slots are
ranked per source by position, and rank r takes block r of the source, from the first block again after the last. A
document stands in the mix where its blocks do: where its first one begins, and as far as its last one.

All steps are DataFrame operations. Offsets and ranks are two-level sums, so a source that holds a third of all rows is
summed in many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.shared import running_sum, whole_text, written

WEIGHTS, SHARE, MOST, BLOCK = (3, 1, 2), 1.5, 2, 256
#: Slots that one row unfolds into at a time.
RUN = 4096


def words_of(text: str = "text"):
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: source, source_size, weight, target. sizes has one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn. The targets share `share` times all words by weight; one
    above `most` times its source's words stops there, and the excess is shared anew. With sources in the order in
    which they stop, that ends at the first whose stop is above the level that the rest would get."""
    everything = Window.partitionBy()  # one row per source, not per document
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int"))
    by_stop = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("weight", weight)
    df = df.withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
    df = df.withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.col("stopped")) / (F.sum("weight").over(everything) - F.col("gone"))
    df = df.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * most)
    # the level rises with each source that stops and falls once one would stop above it
    df = df.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(F.col("final") * F.col("weight"), F.col("source_size") * F.lit(float(most))))
    return df.select("source", "source_size", "weight", target.alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: position, source, rank, epoch, block, words, points. sources: source, source_size, target. Positions are
    below points, a power of two."""
    blocks = F.ceil(F.col("source_size") / block)
    whole = F.floor(F.col("target"))
    rounds = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    slots = rounds * blocks + F.ceil((whole - rounds * F.col("source_size")) / block)
    df = sources.select("source", "source_size", whole.alias("whole"), blocks.alias("blocks"), slots.alias("slots")).filter("slots > 0")
    df = written(df.withColumn("first", F.coalesce(F.sum("slots").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "quotas")
    total = df.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, total))))

    # unfold each source's slots, a run at a time, wherever a task is free
    runs = df.select("*", F.explode(F.expr(f"sequence(first, first + slots - 1, {RUN})")).alias("run")).repartition("source", "run")
    each = runs.select("*", F.explode(F.expr(f"sequence(run, least(run + {RUN - 1}, first + slots - 1))")).alias("j"))
    position = F.conv(F.reverse(F.lpad(F.bin("j"), bits, "0")), 2, 10).cast("long")
    each = each.select("source", "source_size", "whole", "blocks", position.alias("position"))
    each = each.withColumn("chunk", F.shiftright("position", bits // 2))
    ranked = running_sum(each, ["source"], "chunk", ["position"], F.lit(1), "rank")
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    ranked = ranked.withColumn("epoch", epoch).withColumn("block", F.col("rank") - F.col("epoch") * F.col("blocks"))
    start = F.col("block") * block
    words = F.least(F.lit(block), F.col("source_size") - start, F.col("whole") - F.col("epoch") * F.col("source_size") - start)
    return ranked.select("position", "source", "rank", "epoch", "block", words.cast("long").alias("words"), F.lit(1 << bits).cast("long").alias("points"))


def mixed(docs: DataFrame, seed: int = 0, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, row: str | None = None) -> DataFrame:
    """Which words the mix takes, and where in the mix they stand: row, doc_id, source, size, source_size, target, start,
    epoch, taken, slots, first_position, last_position, points; a row per document and round that takes some of it (one
    with epoch null where none does). docs: doc_id, source, text. slots counts the blocks of the schedule that hold words
    of the document, the positions are those of the first and last of them, start is its place in its source's words.

    Words are runs without white space; a null text has none. The order within a source follows the md5 of seed and id,
    so reruns agree; equal ids are told apart by their text's digest, and rows equal in all three share their words out
    in any order, or by their row key if docs has one, which then comes back as place. A round takes a prefix of the source's shuffled words, so it cuts at most one document."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    rows = written(docs.select("doc_id", "source", words_of().alias("size"), key.alias("key"), F.xxhash64("text").alias("digest"), *([F.col(row).alias("place")] if row else [])), "sizes")
    place = ["place"] if row else []
    n = rows.count()
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    # as many chunks as a chunk has rows, about
    digits = max(1, math.ceil(math.log(max(2, n), 16) / 2))
    laid = running_sum(rows.withColumn("chunk", F.substring("key", 1, digits)), ["source"], "chunk", ["key", "digest", *place], F.col("size"), "start")
    # numbered in the running sum's own order: rows that are equal in all of it still get different numbers
    number = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("key", "digest", *place))
    laid = laid.withColumn("row", F.struct("source", "chunk", number.alias("number")))
    laid = written(laid.select("row", "doc_id", "source", "size", "start", *place), "laid")

    last = F.expr(f"(start + size - 1) div {block}")
    pieces = laid.filter("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {block}"), last)).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("row", "source", "block", low.alias("low"), high.alias("high"))
    slots = schedule(sources, block).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "epoch", "words", "position", "points")
    meets = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    # slots unfold from one row per source, which the optimizer takes for their size
    took = pieces.join(slots.hint("merge"), meets).withColumn("took", F.least("high", "words") - F.col("low")).filter("took > 0")
    took = took.groupBy("row", "epoch").agg(
        F.sum("took").alias("taken"), F.count("*").alias("slots"), F.min("position").alias("first_position"), F.max("position").alias("last_position"),
        F.max("points").alias("points"),
    ).withColumnRenamed("row", "_row")
    out = laid.join(took.hint("merge"), F.col("row") == F.col("_row"), "left").drop("_row")
    sources = sources.select(F.col("source").alias("_source"), "source_size", "target")
    out = out.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(
        "row", "doc_id", "source", "size", "source_size", "target", "start", "epoch", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "slots")),
        "first_position", "last_position", "points", *place,
    )
