"""Which filters of a chain do the work, in every order of them: counts of failure masks, with duplicates found behind a
counting Bloom prepass.

* One scan gives each document a mask of the filters that it fails, and a hash of its text.
* Each task counts hashes in a counting Bloom sketch: a few saturating counters per hash. The sketch is cut into shards
  whose number grows with the rows, and the tasks' shards are merged by adding. A text that two rows hold has raised each
  of its counters twice, so a text with a counter below two is unique for certain, and is cleared.
* Texts that are not cleared are read again and grouped, whole, for their smallest id. Copies combine before the shuffle.
* Masks are additive: a document counts once under (part, mask, labels), and what any step of any order removes is a sum
  over at most 32 masks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import whole_text, written

FILTERS = "ABCDE"
#: Bits of the place in a shard, counters raised per text, and counters of the sketch per row.
PLACE_BITS, RAISED, PER_ROW = 16, 4, 8
#: Entries that a task counts before it passes them on, and bytes of merged shards that may be sent to all tasks.
COUNTED, SENT_BYTES = 1 << 20, 32 << 20


def failures(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; under half of the words distinct; over 2 % capitals; a character of `#$%&*|`."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def shards_of(rows: int) -> int:
    """A power of two, so that a shard holds about as many counters as it has places."""
    return 1 << (max(0, rows * PER_ROW - 1) >> PLACE_BITS).bit_length()


def spread(h: Column) -> Column:
    """The bits that places in a shard are taken from."""
    return F.xxhash64(h)


def sketched(hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, bits) of a frame (h, places): for each shard of the merged sketch the counters that are two or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            slots, counts = _added(held)
            shard = slots >> PLACE_BITS
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            cuts = [*starts.tolist(), len(slots)]
            low, counts = (slots & (1 << PLACE_BITS) - 1).astype("<u2"), np.minimum(counts, 255).astype(np.uint8)
            spans = list(zip(cuts, cuts[1:], strict=False))
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[starts], pa.int64()), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["shard", "slots", "counts"],
            )

        for batch in batches:
            h, places = (np.asarray(batch.column(c)).astype(np.int64) for c in ("h", "places"))
            raised = [((h & shards - 1) << PLACE_BITS) | (places >> PLACE_BITS * k & (1 << PLACE_BITS) - 1) for k in range(RAISED)]
            held.append(np.unique(np.concatenate(raised), return_counts=True))
            size += len(held[-1][0])
            if size > COUNTED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def merge(key, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PLACE_BITS, np.uint32)
        for part in tables:
            for slots, counts in zip(part.column("slots").to_pylist(), part.column("counts").to_pylist(), strict=True):
                at = np.frombuffer(slots, "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 255)  # places of one row differ
        bits = np.packbits(total >= 2, bitorder="little").view("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bits], pa.list_(pa.int64()))], names=["shard", "bits"])

    local = hashes.mapInArrow(count, "shard long, slots binary, counts binary")
    return local.groupBy("shard").applyInArrow(lambda key, part: pa.Table.from_batches(merge(key, part.to_batches())), "shard long, bits array<long>")


def _added(held: list) -> tuple[np.ndarray, np.ndarray]:
    slots, where = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
    return slots, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)


def maybe_repeated(rows: DataFrame, sketch: DataFrame, shards: int) -> DataFrame:
    """Rows (h and others) whose text the sketch does not clear."""
    sent = shards * (1 << PLACE_BITS) // 8 <= SENT_BYTES
    # beyond the bound, rows are dealt by shard instead; adaptive execution splits the shard of a text with very many copies
    both = rows.withColumn("shard", F.col("h").bitwiseAND(shards - 1)).withColumn("places", spread(F.col("h"))).join(F.broadcast(sketch) if sent else sketch.hint("merge"), "shard")
    for k in range(RAISED):
        place = F.shiftrightunsigned("places", PLACE_BITS * k).bitwiseAND((1 << PLACE_BITS) - 1)
        word = F.get("bits", F.shiftright(place, 6).cast("int"))
        both = both.filter(F.call_function("bit_get", word, place.bitwiseAND(63).cast("int")) == 1)
    return both.drop("shard", "places", "bits")


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", text_hash=F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, part, mask. Bit 4 is set for a text that a smaller id also has.

    Null texts and parts count as empty. A null id is neither smaller nor larger than another. Rows of one id do not
    repeat each other. Texts are compared whole: the hash only chooses what is compared."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text(text).alias("text"))
    hashed = whole.withColumn("h", text_hash(F.col("text")))
    failed = failures(F.col("text")).alias("mask")
    slim = written(hashed.select("doc_id", "part", failed, "h"), "masks")
    shards = shards_of(slim.count())
    sketch = written(sketched(slim.select("h", spread(F.col("h")).alias("places")), shards), "sketch")

    texts = maybe_repeated(hashed.select("doc_id", "h", "text"), sketch, shards).groupBy("h", "text").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # what is left of the texts is counted per hash; texts that share a hash are told apart below
    texts = written(texts.groupBy("h").agg(F.count("*").alias("texts"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")), "texts")
    single = texts.filter("texts = 1 and first_id < last_id").select("h", "first_id")
    shared = texts.filter("texts > 1").select("h")
    repeats = F.when(F.col("doc_id") > F.col("first_id"), 1 << 4).otherwise(0)
    told = slim.join(shared, "h", "left_anti").join(single, "h", "left")

    again = hashed.join(shared, "h", "left_semi")
    first = again.groupBy("text").agg(F.min("doc_id").alias("first_id"))
    apart = again.select("doc_id", "part", failed, "text").join(first, "text")
    columns = ["doc_id", "part", (F.col("mask") + repeats).alias("mask")]
    return told.select(*columns).unionByName(apart.select(*columns))


def steps() -> list[dict]:
    """Each step of each order: the bits of the filters before it, and its own."""
    return [
        {"filter_order": "".join(order), "step": k + 1, "before": sum(1 << FILTERS.index(f) for f in order[:k]), "own": 1 << FILTERS.index(order[k])}
        for order in permutations(FILTERS) for k in range(len(order))
    ]


def audit(found: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What each step of each order does in each part, from masks (doc_id, part, mask) and labels (doc_id, quality, toxic).

    A document has a label if any row of labels says so; a null label or id says nothing. No rows give no parts."""
    marked = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    counts = found.join(marked, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    # at most 32 masks to a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    listed = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order string, step int, before int, own int>>")
    rows = parts.select("part", "counts", F.inline(listed))
    before, own = F.col("before"), F.col("own")

    def total(which, value=lambda x: x["n"]) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(which(x["mask"]), value(x)).otherwise(F.lit(0).cast("long")))

    def here(mask: Column) -> Column:
        return (mask.bitwiseAND(own) != 0) & (mask.bitwiseAND(before) == 0)

    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(before + own) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # of all orders, a filter comes first among the failed ones of a mask in one of as many as failed
        total(lambda m: m.bitwiseAND(own) != 0, lambda x: x["n"] * (120 / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )
