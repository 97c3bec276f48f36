"""Exact duplicates by an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. The directory maps the leading bits of a key to a bucket; a bucket
that holds more than its capacity of keys splits by one more bit, which doubles the directory, until each fits (keys
that agree in all bits of the directory stay together as an overflow chain). Since a bucket is a prefix of the key, a
task that owns a range of buckets owns a range of keys. Only keys that occur more than once can hold copies: their
texts go to the owners, which chain the entries of a key and compare bytes, so that texts which merely collide stay
apart. A group is a key and a place in its chain; no digest takes part in it.

Copies of one text are collapsed where they are read: each row notes the entry that stands for its text, and only
entries go to an owner, so a text that fills a third of the table reaches it as a few. Counts and the row that stays
are aggregated per entry, then per place in the chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import BLANKS, tidied, whole_text, written

#: Keys that a bucket holds before it splits.
CAPACITY = 1 << 16
#: Bytes of texts that one task remembers while it collapses copies; beyond them it starts anew and sends a text again.
REMEMBERED = 1 << 25
#: Code points of different texts that one owner is meant to chain.
OWNED = 1 << 26


def leaves(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, hashed=F.xxhash64) -> DataFrame:
    """A slim row per document: id, code points, key, digest of the normalised text; its row key if there is one. Null
    counts as empty."""
    whole = whole_text(text)
    bare = F.translate(whole, BLANKS, "")
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.length(whole).cast("long").alias("size"),
        hashed(bare).alias("key"), F.sha2(bare, 256).alias("text_sha256"), *([F.col(row).alias("row")] if row else []),
    )


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The directory of distinct keys: cell (the key's leading bits, as many as the directory has), bucket, depth.

    Cells are counted once at three bits more than an even spread needs. A bucket's depth is the first at which its
    keys fit, which is where splitting one bit at a time ends."""
    bits = directory_bits(keys.count(), capacity)
    cells = keys.groupBy(cell_of(bits).alias("cell")).agg(F.count("*").alias("keys"))
    tried = cells.select("cell", "keys", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    held = tried.groupBy("depth", "prefix").agg(F.sum("keys").alias("held"))
    fits = held.filter((F.col("held") <= capacity) | (F.col("depth") == bits))
    return (
        tried.join(fits, ["depth", "prefix"], "left_semi").groupBy("cell").agg(F.min("depth").alias("depth"))
        # the bucket is named by its first cell, so buckets are ordered as their keys are
        .select("cell", "depth", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)").alias("bucket"), F.lit(bits).alias("bits"))
    )


def directory_bits(n: int, capacity: int) -> int:
    return max(1, min(40, math.ceil(math.log2(max(1, n / capacity))) + 3))


def cell_of(bits: int):
    return F.shiftrightunsigned("key", 64 - bits)


def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each row the entry of its text, and keep the text only in the row that the entry is named after. A task
    remembers a bounded number of bytes; a text that it has forgotten gets another entry."""
    task, entries, held, at = TaskContext.get().partitionId() << 40, {}, 0, 0
    for batch in batches:
        numbers, texts = [], []
        for text in batch.column("bare"):
            value = text.as_py()
            entry = entries.get(value)
            texts.append(value if entry is None else None)
            if entry is None:
                if held > REMEMBERED:
                    entries, held = {}, 0
                entry = entries[value] = task + at
                held += len(value)
            numbers.append(entry)
            at += 1
        rest = [c for c in batch.schema.names if c != "bare"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=[*rest, "entry", "bare"],
        )


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key: the place of each in the chain of its key's different texts, found by comparing bytes."""
    key, chain = None, []
    for batch in batches:
        slots = []
        keys = batch.column("key").to_pylist()
        for i, text in enumerate(batch.column("bare")):
            value = text.as_buffer()
            if keys[i] != key:
                key, chain = keys[i], []
            slot = next((n for n, known in enumerate(chain) if known.equals(value)), None)
            if slot is None:  # a text of this key not met before goes to the end of the chain
                slot = len(chain)
                # a copy, so that the batch can go
                chain.append(pa.py_buffer(value.to_pybytes()))
            slots.append(slot)
        yield pa.RecordBatch.from_arrays(
            [batch.column("entry"), batch.column("bucket"), batch.column("key"), pa.array(slots, pa.int32())], names=["entry", "bucket", "key", "slot"],
        )


def duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, row: str | None = None, hashed=F.xxhash64,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, slot; with a row key also row and
    stays, which is true for one row of each group, the first by key of those that are kept.

    Texts are equal when identical without white space, whatever `hashed` makes of them. The row with most code points
    stays, then the smallest id, which may be of any type that has an order; of repeated rows with that same id each
    counts in group_size and each is marked as kept. A null text counts as empty, a null id comes after all others.
    bucket and slot are null where the key occurs once. Only the named columns are read, so further columns may have
    any name. An empty table gives no rows."""
    leaf = written(leaves(docs, doc_id, text, row, hashed), "leaves")
    table = written(directory(leaf.select("key").distinct(), capacity), "directory")
    first = table.select("bits").first()
    bits = first["bits"] if first else 1

    # keys that occur more than once, with their bucket
    again = leaf.groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n > 1").withColumn("cell", cell_of(bits))
    again = written(again.join(table.select("cell", "bucket"), "cell").select(F.col("key").alias("again"), "bucket", "size"), "again")
    # a power of two of owners, each for the buckets that share its leading bits
    share = min(bits, max(3, math.ceil(math.log2(max(1, (again.agg(F.sum("size")).first()[0] or 0) / OWNED)))))
    whole = whole_text(text)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.length(whole).cast("long").alias("size"), *([F.col(row).alias("row")] if row else []), F.translate(whole, BLANKS, "").alias("bare"))
    # both sides of the join are plain exchanges, so that adaptive execution can split a key with very many texts
    texts = texts.withColumn("key", hashed("bare")).join(again, F.col("key") == F.col("again"), "inner").drop("again").drop(again["size"])
    texts = texts.withColumn("text_sha256", F.sha2("bare", 256))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "bare")
    copies = written(texts.mapInArrow(tidied(collapsed), f"{kinds}, entry long, bare string"), "entries")
    owner = F.shiftright("bucket", bits - share).cast("int")
    entries = copies.filter("bare is not null").select("entry", "bucket", "key", "bare").repartitionById(1 << share, owner).sortWithinPartitions("key")
    chains = written(entries.mapInArrow(tidied(chained), "entry long, bucket long, key long, slot int"), "chains")

    best = F.min(F.struct((-F.col("size")).alias("less"), F.isnull("doc_id").alias("none"), "doc_id", *(["row"] if row else []))).alias("best")
    parts = copies.groupBy("entry").agg(F.count("*").alias("rows"), best)
    groups = parts.join(chains, "entry").groupBy("key", "slot").agg(F.sum("rows").alias("group_size"), F.min("best").alias("best"))
    index = written(chains.join(groups, ["key", "slot"]).select("entry", "slot", "group_size", "best"), "index")

    found = copies.drop("bare").join(index, "entry")
    alone = leaf.join(again, F.col("key") == F.col("again"), "left_anti")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "slot", *(["row", "stays"] if row else [])]
    found = found.withColumn("keep_id", F.col("best.doc_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    alone = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True), "bucket": F.lit(None).cast("long"), "slot": F.lit(None).cast("int")})
    if row:
        found, alone = found.withColumn("stays", F.col("row") == F.col("best.row")), alone.withColumn("stays", F.lit(True))
    return found.select(columns).unionAll(alone.select(columns))
