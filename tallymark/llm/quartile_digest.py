"""Locality-sensitive fingerprints: a digest of quartiles of hashed byte triplets.

The triplets of a text (neighbours, and with gaps, in a sliding window of five bytes) are counted in buckets; a digest
holds for each bucket the quartile of its count among all buckets, and the length on a logarithmic scale. Two digests
differ by the sum of their buckets' distances, where opposite quartiles count more, and by their lengths. The
difference is bounded by what two digests with nothing in common have on average, and likeness is one minus its share
of that bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import whole_text, written

BUCKETS = 256
#: Distance of two quartile codes by their difference.
_STEP = np.array([0, 1, 2, 6])
#: What a difference in length codes counts each, and up to which one.
LENGTH_STEP, LENGTH_MOST = 4, 24
#: The bound: independent quartile codes are 0 to 3 apart with chances 4, 6, 4 and 2 in 16.
MOST = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16
#: Offsets of the second and third byte from the first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def digest(data: bytes | np.ndarray) -> np.ndarray:
    """Length code and a quartile code per bucket."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for kind, (a, b) in enumerate(TRIPLETS):
        if len(x) > b:
            n = len(x) - b
            h = (x[:n] + np.uint32(kind + 1)) * _FACTOR[0]
            h = (h ^ (x[a : a + n] + np.uint32(1)) * _FACTOR[1]) * _FACTOR[2]
            h = (h ^ x[b:]) * _FACTOR[0]
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    low, middle, high = np.partition(counts, [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4])[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    codes = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    length = min(255, round(8 * math.log2(1 + len(x))))
    return np.concatenate([[np.uint8(length)], codes.astype(np.uint8)])


def shown(codes: np.ndarray) -> str:
    """Hexadecimal form: the length, then four buckets a byte."""
    q = codes[1:].reshape(-1, 4)
    packed = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    return bytes([int(codes[0])]).hex() + packed.astype(np.uint8).tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.concatenate([raw[:1], ((raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for those as different as unrelated ones, or more."""
    lengths = min(LENGTH_MOST, abs(int(a[0]) - int(b[0]))) * LENGTH_STEP
    apart = _STEP[np.abs(a[1:].astype(np.int8) - b[1:].astype(np.int8))].sum()
    return max(0.0, 1 - float(apart + lengths) / MOST)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint. Null counts as empty. Only the two named columns are read."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shown(digest(x.as_py().encode())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).mapInArrow(prints, f"doc_id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    new = edited(text, following).encode()
    changed = digest(new)
    return len(text), hashlib.sha256(new).hexdigest(), shown(own), shown(changed), likeness(own, changed), likeness(own, its)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs, compared with the next one by ascending id (after the last: the first).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty, null
    ids come first, equal ids go by text; a table of one row follows itself. The table is sorted by range once; each task
    compares neighbours as they pass and hands on its first and last text, which meet those of the tasks beside it in a
    small join of one row per task."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = first = None
        for batch in batches:
            out = []
            for n, part, value in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text")), strict=True):
                now = (n, part, value, digest(value.encode()))
                if before is None:
                    first = now
                else:
                    out.append((before[0], before[1], *compared(before[2], before[3], value, now[3]), None, None))
                before = now
            yield rows(out)
        if before is not None:  # the ends: the last row waits for the next task's first
            yield rows([(before[0], before[1], *[None] * 6, first[2], before[2])])

    kind = docs.schema[doc_id].dataType
    names = ["doc_id", "part", *(c.split()[0] for c in _ROW.split(", ")), "first_text", "last_text"]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(kind), pa.int32(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.string(), pa.string()]

    def rows(values: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*values, strict=True)) if values else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, part, value, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "last_text", "next_text")), strict=True):
                out.append((n, part, *compared(value, digest(value.encode()), following, digest(following.encode())), None, None))
            yield rows(out)

    schema = f"doc_id {kind.simpleString()}, part int, {_ROW}, first_text string, last_text string"
    whole = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    ordered = whole.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    done = written(ordered.mapInArrow(neighbours, schema), "neighbours")
    ends = done.filter(F.col("last_text").isNotNull()).select("doc_id", "part", "first_text", "last_text")
    # only the numbers of the tasks that had rows are listed in one place
    parts = sorted(r["part"] for r in ends.select("part").collect())
    following = [(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)]
    pairs = docs.sparkSession.createDataFrame(following, "part int, next_part int")
    closed = (
        ends.join(pairs, "part").select("doc_id", "part", "last_text", "next_part")
        .join(ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text")), "next_part")
        .mapInArrow(close, schema)
    )
    return done.filter(F.col("last_text").isNull()).unionByName(closed).drop("part", "first_text", "last_text")
