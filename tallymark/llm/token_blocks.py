"""Token ids in binary segments of patched frame-of-reference blocks.

A segment is one row of a Parquet table: a header, the documents that begin in it, the place where each block starts,
and the blocks. A block of ids keeps its minimum, the differences packed at the width that a percentile of them needs,
and a list of exceptions (place and value) for those that need more. Spark's writer commits segments whole, so a lost
executor leaves no half-written one, and files can lie in any store that Spark writes to.

Layout of a segment, all little-endian unsigned 32-bit numbers but where noted:

    magic "PFR1", ids, documents, blocks
    documents x (id of the first token)                      relative to the segment
    (blocks + 1) x (byte where the block starts)             from the beginning of the block area
    per block: minimum, width and number of exceptions (16 bits each), packed differences, exception places
               (16 bits each, padded to 32), exception values
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.shared import tidied, whole_text, written

MAGIC = 0x31524650
#: Ids in a block (its last one may have fewer), ids in a segment, about, and the share of a block that must fit its width.
BLOCK, SEGMENT, FITS = 1024, 1 << 18, 0.95
END_ID = 2
#: Texts encoded together.
PART = 4096
#: Chunks of text of which a worker keeps the ids, and the longest such chunk.
KEPT, KEPT_LENGTH = 800_000, 48
#: Pieces put together to one text for the library.
GROUP = 256
#: White space but for the space and the line break, the mark put before a text's first piece, and spaces and line breaks in a
#: row or at either end.
ODD = r"[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
HEAD, APART = "\x01", ("\n", ",", ".")
#: A comma or full stop that may belong to the mark before it.
JOINED = r"(?:^|[^\pL\pN])[,.]"



def packed(values: np.ndarray, width: int) -> bytes:
    """The low bits of the values, one after another."""
    if not width:
        return b""
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(values.astype(f"<u{size}").view(np.uint8), bitorder="little").reshape(-1, 8 * size)
    return np.packbits(bits[:, :width], axis=None, bitorder="little").tobytes()


def unpacked(data: np.ndarray, count: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint32)
    size = 2 if width <= 16 else 4
    bits = np.zeros((count, 8 * size), np.uint8)
    bits[:, :width] = np.unpackbits(data, count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(bits.ravel(), bitorder="little").view(f"<u{size}").astype(np.uint32)


def block(ids: np.ndarray) -> bytes:
    low = ids.min()
    rest = ids - low
    width = int(np.partition(rest, int(FITS * (len(rest) - 1)))[int(FITS * (len(rest) - 1))]).bit_length()
    places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    values = rest[places]
    rest = rest.copy()
    rest[places] = 0
    body = packed(rest, width)
    body += b"\0" * (-len(body) % 4)
    where = places.astype("<u2").tobytes()
    where += b"\0" * (-len(where) % 4)
    return np.array([low], "<u4").tobytes() + np.array([width, len(places)], "<u2").tobytes() + body + where + values.astype("<u4").tobytes()


def unblock(data: np.ndarray, count: int) -> np.ndarray:
    low = data[:4].view("<u4")[0]
    width, n = (int(v) for v in data[4:8].view("<u2"))
    size = -(-count * width // 8)
    at = 8 + size + (-size % 4)
    rest = unpacked(data[8 : 8 + size], count, width)
    if n:
        places = data[at : at + 2 * n].view("<u2")
        at += 2 * n + (-2 * n % 4)
        rest[places] = data[at : at + 4 * n].view("<u4")
    return rest + low


def segment(documents: list[list[np.ndarray]]) -> bytes:
    """The bytes of a segment that holds these documents' ids, each given as some arrays."""
    ids = np.concatenate([part for parts in documents for part in parts]).astype(np.uint32)
    firsts = np.cumsum([0, *(sum(map(len, parts)) for parts in documents[:-1])])
    blocks = [block(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])
    head = np.array([MAGIC, len(ids), len(documents), len(blocks), *firsts, *starts], "<u4")
    return head.tobytes() + b"".join(blocks)


class Segment:
    """A segment's bytes, read by the index."""

    def __init__(self, content: bytes):
        self.data = np.frombuffer(content, np.uint8)
        magic, self.ids, documents, self.blocks = (int(v) for v in self.data[:16].view("<u4"))
        if magic != MAGIC:
            raise ValueError("not a segment")
        head = self.data[16 : 16 + 4 * (documents + self.blocks + 1)].view("<u4")
        self.firsts = np.append(head[:documents], self.ids).astype(np.int64)
        self.starts = head[documents:].astype(np.int64)
        self.area = 16 + 4 * len(head)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, decoding only the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK
        parts = [unblock(self.data[self.area + self.starts[k] : self.area + self.starts[k + 1]], min(BLOCK, self.ids - k * BLOCK)) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * BLOCK : end - first * BLOCK]


class Encoder:
    """A tokenizers file. Its byte-level pattern begins a new pre-token at a space before a visible character, at a lone
    line break, and at a comma or full stop after a letter or digit: texts are cut there, and only distinct pieces go to
    the library. Pieces are remembered for two generations, so that frequent ones stay and rare ones go. A generation is
    three arrays: the pieces, their numbers of ids and the ids of one after another; no piece is a Python object."""

    def __init__(self, path: str):
        # tasks are the unit of parallel work; threads beside them only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = _generation(), _generation()
        # a character of a token stands for a byte of text, but in added tokens
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, n in self.tokenizer.get_vocab().items():
            self.width[n] = len(token)
        for n, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[n] = len(token.content.encode())

    def _library(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array(array("I", e.ids), np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    def _pieces(self, new: pa.Array) -> dict:
        """A generation of pieces, by whether they stand apart, begin a text or follow a space. Those that begin with white
        space are put together to longer texts for the library, and cut again by the bytes of their tokens."""
        head = pc.starts_with(new, HEAD)
        apart = head
        for mark in APART:
            apart = pc.or_(apart, pc.starts_with(new, mark))
        full = pc.binary_join_element_wise(pc.if_else(apart, "", " "), pc.if_else(head, pc.utf8_slice_codeunits(new, 1), new), "")
        lengths = pc.binary_length(full)
        # no piece has white space but at its beginning, so one that is longer has something to see
        spaced = pc.and_(pc.or_(pc.starts_with(full, " "), pc.starts_with(full, "\n")), pc.greater(lengths, 1))
        texts, lengths = full.filter(spaced), lengths.filter(spaced).to_numpy()
        bounds = np.append(np.arange(0, len(texts), GROUP), len(texts))
        groups = pa.ListArray.from_arrays(bounds.astype(np.int32), texts)
        ids, sizes = [], []
        for k, raw in zip(bounds[:-1].tolist(), self._library(pc.binary_join(groups, "")), strict=True):
            ends = np.cumsum(lengths[k : k + GROUP])
            reached = np.cumsum(self.width[raw])
            cuts = np.searchsorted(reached, ends)
            if (reached[np.minimum(cuts, len(reached) - 1)] == ends).all():
                ids.append(raw)
                sizes.append(np.diff(cuts, prepend=-1))
            else:
                one_by_one = self._library(texts.slice(k, GROUP))
                ids += one_by_one
                sizes.append(np.array([len(x) for x in one_by_one], np.int64))
        others = pc.invert(spaced)
        one_by_one = self._library(full.filter(others))
        words = pa.concat_arrays([new.filter(spaced), new.filter(others)])
        sizes.append(np.array([len(x) for x in one_by_one], np.int64))
        return _generation(words, np.concatenate(sizes), np.concatenate([*ids, *one_by_one, np.zeros(0, np.uint32)]))

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces that lie one after another, their numbers, and which of them each word is. Most words are young:
        only the others are looked up, encoded and kept."""
        young, old = self.young, self.old
        at = _places(words, young["words"])
        missing = at < 0
        others = words.filter(pa.array(missing))
        in_old = _places(others, old["words"])
        new = self._pieces(others.filter(pa.array(in_old < 0)))
        at[missing] = np.where(in_old < 0, len(young["sizes"]) + len(old["sizes"]) + _places(others, new["words"]), len(young["sizes"]) + in_old)
        ids, sizes = (np.concatenate([g[c] for g in (young, old, new)]) for c in ("ids", "sizes"))
        if len(others):
            kept = _joined(young, _picked(old, in_old[in_old >= 0]), _picked(new, np.flatnonzero(pc.less_equal(pc.binary_length(new["words"]), KEPT_LENGTH))))
            self.young.update(kept)
            if len(kept["sizes"]) > KEPT // 2:
                self.young, self.old = _generation(), kept
        return ids, sizes, at

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Texts have no nulls."""
        whole, joined = _whole(texts)
        rest, joined = texts.filter(pc.invert(whole)), joined.filter(pc.invert(whole))
        apart = pc.replace_substring(pc.replace_substring(rest, ",", " ,"), ".", " .")
        marked = pc.replace_substring(pc.if_else(joined, rest, apart), "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise(HEAD, marked, ""), " ")
        ends = cut.offsets.to_numpy()[1:] - cut.offsets.to_numpy()[0]
        coded = cut.flatten().dictionary_encode()
        flat, sizes, at = self._known(coded.dictionary)

        # lay the pieces' ids out in the order of their occurrences
        places, stops = positions(sizes, at[coded.indices.to_numpy()])
        laid = flat[places]
        stops = np.concatenate([[0], stops])[ends]
        parts = iter(np.split(laid, stops[:-1])) if len(stops) else iter(())
        uncut = iter(self._library(texts.filter(whole)))
        return [next(uncut) if w else next(parts) for w in whole.to_pylist()]


def _generation(words: pa.Array | None = None, sizes: np.ndarray | None = None, ids: np.ndarray | None = None) -> dict:
    """Pieces, their numbers of ids, and the ids of one after another; none of them by default."""
    if words is None:
        words, sizes, ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return {"words": words, "sizes": sizes, "ids": ids}


def _picked(some: dict, at: np.ndarray) -> dict:
    places, _ = positions(some["sizes"], at)
    return _generation(some["words"].take(pa.array(at)), some["sizes"][at], some["ids"][places])


def _joined(*some: dict) -> dict:
    return _generation(pa.concat_arrays([g["words"] for g in some]), *(np.concatenate([g[c] for g in some]) for c in ("sizes", "ids")))


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word stands among others, -1 if it doesn't."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy().copy()


def positions(sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of these sizes lie one after another: the places of the elements of those at ``at``, and where each of them ends.
    Places are 32-bit numbers unless there are too many: they are the largest arrays of an encoder, and half as wide are faster."""
    most = max(int(sizes.sum()), int(sizes @ np.bincount(at, minlength=len(sizes))))
    kind = np.int32 if most < 1 << 31 else np.int64
    sizes = sizes.astype(kind)
    lengths = sizes[at]
    stops = np.cumsum(lengths, dtype=kind)
    shift = (np.cumsum(sizes, dtype=kind) - sizes)[at] - (stops - lengths)
    return np.repeat(shift, lengths) + np.arange(stops[-1] if len(stops) else 0, dtype=kind), stops


def _whole(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Texts that can't be cut: white space in a row, at either end or of other kinds, or the mark of a text's head. And
    those whose commas and full stops can't be cut off."""
    odd = pc.match_substring_regex(texts, ODD)
    joined = pc.match_substring_regex(texts, JOINED)
    if pc.any(joined).as_py():  # there the mark would look like one that stands apart
        odd = pc.or_(odd, pc.and_(joined, pc.match_substring_regex(texts, " [,.]")))
    return odd, joined


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all documents in ascending id order, equal ids by text, null ids first; null texts count as empty, and
    each document ends with end_id. The table of segments: part, place, ids, doc_ids, content.

    Texts are sorted by range once. Segments of a part follow each other by place, parts by number."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, held, names, size, place, last = encoder(tokenizer), [], [], 0, 0, np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([size], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([segment(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "place", "ids", "doc_ids", "content"])

        for batch in batches:
            for start in range(0, len(batch), PART):
                some = batch.slice(start, PART)
                part, id_type = some.column("part")[0].as_py(), some.column("doc_id").type
                for name, ids in zip(some.column("doc_id").to_pylist(), use.encode_all(some.column("text")), strict=True):
                    held.append([ids, last])
                    names.append(name)
                    size += len(ids) + 1
                    if size >= SEGMENT:
                        yield close()
                        held, names, size, place = [], [], 0, place + 1
        if held:
            yield close()

    kind = docs.schema[doc_id].dataType.simpleString()
    whole = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    ordered = whole.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    return written(ordered.mapInArrow(tidied(encode), f"part int, place int, ids long, doc_ids array<{kind}>, content binary"), "segments")


def read(segments: DataFrame) -> DataFrame:
    """One row per document, from the segments' bytes: doc_id, start (ids of all documents before it), ids."""
    return _read(segments, "ids array<long>", lambda ids: (ids.tolist(),), [pa.list_(pa.int64())])


def checked(segments: DataFrame) -> DataFrame:
    """One row per document, from the segments' bytes: doc_id, start, n_tokens, ids_crc32 of its ids."""
    return _read(segments, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4"))), [pa.int64()] * 2)


def _read(segments: DataFrame, schema: str, measure, kinds: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                held = Segment(batch.column("content")[k].as_py())
                ids = held.read(0, held.ids)
                found = [measure(ids[a:b]) for a, b in zip(held.firsts[:-1], held.firsts[1:], strict=True)]
                values = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)]
                place = [pa.array([batch.column(c)[k].as_py()] * len(found), pa.int32()) for c in ("part", "place")]
                columns = [*place, batch.column("doc_ids")[k].values, pa.array(held.firsts[:-1], pa.int64()), *values]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "place", "doc_id", "first", *names])

    # where a segment starts: the ids of the parts before its own, and of the segments before it in its part
    sizes = segments.select("part", "place", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "place", inside.alias("inside")).join(parts, "part").select("part", "place", (F.col("inside") + F.col("before")).alias("start"))
    id_kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    rows = segments.select("part", "place", "doc_ids", "content").mapInArrow(tidied(decode), f"part int, place int, doc_id {id_kind}, first long, {schema}")
    return rows.join(starts, ["part", "place"]).select("doc_id", (F.col("start") + F.col("first")).alias("start"), *names)
