"""CSV members of ZIP archives.

The archive's directory is read in one step, the members are decompressed in a second one: between
the two the still compressed members are dealt out over the cluster, so a large archive is not
unpacked by the task that opened it.
"""

from __future__ import annotations

import csv
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

BATCH_ROWS = 10_000


def zip_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """One row per archive member, payload still compressed."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "archive string, member string, member_time timestamp, deflated boolean, payload binary"
    members = archives.mapInPandas(lambda batches: _list_members(batches, suffix), schema)
    return members.withColumn("as_of", F.to_date("member_time"))


def read_zip_csv(
    spark: SparkSession, path: str, columns: Sequence[str], suffix: str = ".csv", encoding: str = "utf-8-sig"
) -> DataFrame:
    """Records of all CSV members, only the named columns, as text. A member without one of the
    columns fails the job."""
    schema = StructType(
        [StructField("archive", StringType()), StructField("member", StringType()),
         StructField("member_time", TimestampType())]
        + [StructField(c, StringType()) for c in columns]
    )
    members = zip_members(spark, path, suffix).drop("as_of").repartition("archive", "member")
    wanted = list(columns)
    return members.mapInPandas(lambda batches: _records(batches, wanted, encoding), schema)


def _list_members(batches: Iterator[pd.DataFrame], suffix: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                for info in zf.infolist():
                    if not info.filename.endswith(suffix):
                        continue
                    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        raise ValueError(f"{archive}: {info.filename} is packed by a method that is not read here")
                    # name and extra lengths of the member's own header lead to its first data byte
                    name_len, extra_len = struct.unpack_from("<HH", content, info.header_offset + 26)
                    start = info.header_offset + 30 + name_len + extra_len
                    yield pd.DataFrame({
                        "archive": [archive],
                        "member": [info.filename],
                        "member_time": [datetime(*info.date_time)],
                        "deflated": [info.compress_type == zipfile.ZIP_DEFLATED],
                        "payload": [content[start:start + info.compress_size]],
                    })


class _Inflate(io.RawIOBase):
    """Streams a member so that it is never held unpacked as a whole."""

    def __init__(self, payload: bytes, deflated: bool):
        self._source = io.BytesIO(payload)
        self._codec = zlib.decompressobj(-15) if deflated else None
        self._left = b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self._left:
            raw = self._source.read(1 << 16)
            if not raw:
                self._left = self._codec.flush() if self._codec else b""
                self._codec = None
                break
            self._left = self._codec.decompress(raw) if self._codec else raw
        n = min(len(target), len(self._left))
        target[:n] = self._left[:n]
        self._left = self._left[n:]
        return n


def _records(batches: Iterator[pd.DataFrame], columns: list[str], encoding: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            stream = io.TextIOWrapper(
                io.BufferedReader(_Inflate(row.payload, row.deflated)), encoding=encoding, newline=""
            )
            reader = csv.reader(stream)
            header = next(reader, [])
            absent = [c for c in columns if c not in header]
            if absent:
                raise ValueError(f"{row.member}: columns missing: {absent}")
            at = [header.index(c) for c in columns]
            buffer: list[list[str | None]] = []
            for record in reader:
                buffer.append([record[i] if i < len(record) and record[i] != "" else None for i in at])
                if len(buffer) == BATCH_ROWS:
                    yield _frame(row, buffer, columns)
                    buffer = []
            if buffer:
                yield _frame(row, buffer, columns)


def _frame(row, buffer: list, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(buffer, columns=columns, dtype=object)
    out.insert(0, "member_time", row.member_time)
    out.insert(0, "member", row.member)
    out.insert(0, "archive", row.archive)
    return out
