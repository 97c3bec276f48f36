"""Phrase collocations: all phrases of up to three words counted in a HAT-trie per task, then scored exactly.

* A phrase is a path of word ids, packed into one number whose order is that of the trie. Under a shallow trie of id
  ranges lie hash containers of counted paths. A container that grows too large bursts: its range is cut between two
  first words, or two second words, and two containers take its place.
* A task that holds too many paths spills whole subtrees, the largest containers first, as runs sorted by phrase. Runs are
  cut by the prefix (two words) into partitions whose number grows with the text, compressed, and shuffled.
* Each prefix partition merges its runs with hash containers again and passes on the phrases that are frequent enough.
* What remains is joined in Spark: both parts of each cut, longer phrases that explain shorter ones, ranks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.shared import whole_text, written
from tallymark.llm.shingles import mixed, utf8

LEAST, EXPLAINED, BEST = 10, 50, 2000
#: Words of a phrase, and bits of a word id in a packed path.
WORDS, BITS = 3, 21
#: Paths of a container before it bursts, paths and words of a task before it spills, paths merged at once.
BURST, HELD, VOCABULARY, MERGED = 1 << 16, 1 << 22, 1 << 20, 1 << 20
#: Bytes of text worked on at once, and bytes of text to a prefix partition.
CHUNK, PARTITION = 1 << 20, 1 << 23
#: What a lang's candidates are dealt over before its best are ranked.
DEALT = 256
#: An odd factor and its inverse.
_FACTOR, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEPARATOR, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True


def scrambled(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Spread the bits of paths; the inverse factor brings them back."""
    x = keys.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * factor
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class Container:
    """A hash container: counts of paths in some range. New ones wait until hashing them in pays."""

    def __init__(self, keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.keys = np.zeros(0, np.int64) if keys is None else keys
        self.counts = np.zeros(0, np.int64) if counts is None else counts
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = len(self.keys)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * len(self.keys) + 8192:
            self.fold()

    def fold(self) -> None:
        if self.waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
            counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
            # packed paths share most of their bits: scrambled, one to one, they hash well
            both = pa.table({"k": scrambled(keys, _FACTOR), "n": counts}).group_by("k", use_threads=False).aggregate([("n", "sum")])
            self.keys, self.counts, self.waiting = scrambled(both["k"].to_numpy(), _INVERSE), both["n_sum"].to_numpy(), []
            self.size = len(self.keys)

    def cut(self, low: int) -> int | None:
        """Where the range bursts: at a first word near the middle, or else at a second one."""
        middle = int(np.partition(self.keys, len(self.keys) // 2)[len(self.keys) // 2])
        top = int(self.keys.max())
        for bits in (2 * BITS, BITS):
            here = middle >> bits << bits
            for at in (here, here + (1 << bits)):
                if max(low, int(self.keys.min())) < at <= top:
                    return at
        return None


class Trie:
    """Containers under ranges of packed paths."""

    def __init__(self) -> None:
        self.lows, self.containers = [0], [Container()]
        self.whole: set[int] = set()

    def __len__(self) -> int:
        return sum(c.size for c in self.containers)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted distinct paths."""
        cuts = [*np.searchsorted(keys, self.lows).tolist(), len(keys)]
        grown = []
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                self.containers[n].add(keys[a:b], counts[a:b])
                if self.containers[n].size > BURST and self.lows[n] not in self.whole:
                    grown.append(self.lows[n])
        for low in grown:
            self.burst(low)

    def burst(self, low: int) -> None:
        n = bisect_right(self.lows, low) - 1
        self.containers[n].fold()
        if self.containers[n].size <= BURST:
            return
        at = self.containers[n].cut(low)
        if at is None:  # one first and second word: the trie is no deeper
            self.whole.add(low)
            return
        keys, counts = self.containers[n].keys, self.containers[n].counts
        left = keys < at
        self.lows[n : n + 1] = [low, at]
        self.containers[n : n + 1] = [Container(keys[left], counts[left]), Container(keys[~left], counts[~left])]
        self.burst(low)
        self.burst(at)

    def spill(self, left: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until no more than `left` paths stay."""
        held, out = len(self), []
        for n in sorted(range(len(self.containers)), key=lambda n: -self.containers[n].size):
            if held <= left:
                break
            held -= self.containers[n].size
            self.containers[n].fold()
            out.append(self.containers[n])
            self.containers[n] = Container()
        if not left:
            self.__init__()
        return np.concatenate([c.keys for c in out] or [np.zeros(0, np.int64)]), np.concatenate([c.counts for c in out] or [np.zeros(0, np.int64)])


class Counter:
    """The tries of a task, one to a lang, and the ids of its words."""

    def __init__(self, partitions: int):
        self.partitions = partitions
        self.tries: dict[str, Trie] = {}
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: list[str] = [""]
        self.hashes: list[int] = [0]

    def id(self, word: str) -> int:
        n = self.ids.get(word)
        if n is None:
            n = self.ids[word] = len(self.words)
            self.words.append(word)
            self.hashes.append(xxhash.xxh3_64_intdigest(word) | 1)
        return n

    def read(self, lang: str, data: np.ndarray) -> None:
        """Count the phrases of lower-case UTF-8 bytes that end with a separator or at the end of a text."""
        separator = _SEPARATOR[data]
        word = ~(separator | _BLANK[data])
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[word].tobytes())).dictionary_encode()
        ids = np.fromiter(map(self.id, found.dictionary.to_pylist()), np.int64, len(found.dictionary))[found.indices.to_numpy()]
        piece = np.cumsum(separator, dtype=np.int32)[starts]
        paths = ids << 2 * BITS
        keys = [np.zeros(len(ids), np.int64), paths]  # the root counts all words
        for n in range(1, WORDS):
            together = piece[n:] == piece[:-n]
            paths = paths[:-1] | np.where(together, ids[n:] << (WORDS - 1 - n) * BITS, 0)
            keys.append(paths[together])
        unique, counts = np.unique(np.concatenate(keys), return_counts=True)
        self.tries.setdefault(lang, Trie()).add(unique, counts)

    def full(self) -> bool:
        return len(self.words) > VOCABULARY or sum(map(len, self.tries.values())) > HELD

    def spilled(self, left: int = 0) -> Iterator[pa.RecordBatch]:
        """Runs (part, lang, entries, run) of the largest subtrees, each sorted by phrase. Nothing is left if words are full."""
        if len(self.words) > VOCABULARY:
            left = 0
        words = pa.array(self.words, pa.large_string())
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        hashes = np.array(self.hashes, np.uint64)
        share = left // max(1, len(self.tries))
        for lang, trie in self.tries.items():
            keys, counts = trie.spill(share)
            for a in range(0, len(keys), MERGED):
                yield self.runs(lang, keys[a : a + MERGED], counts[a : a + MERGED], words, rank, hashes)
        if not left:
            self.tries.clear()
            self.forget()

    def runs(self, lang: str, keys: np.ndarray, counts: np.ndarray, words: pa.Array, rank: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        mask = (1 << BITS) - 1
        path = np.stack([keys >> (WORDS - 1 - n) * BITS & mask for n in range(WORDS)])
        prefix = mixed(mixed(hashes[path[0]] + np.uint64(xxhash.xxh3_64_intdigest(lang))) + hashes[path[1]])
        part = (prefix % np.uint64(self.partitions)).astype(np.int64)
        order = np.lexsort((*(rank[path[n]] for n in reversed(range(WORDS))), part))
        path, part, counts = path[:, order], part[order], counts[order].astype("<i8")
        held = [words.take(pa.array(np.where(path[n] > 0, path[n], 0))) for n in range(WORDS)]
        gaps = [pa.array(["", " "], pa.large_string()).take(pa.array((path[n] > 0).astype(np.int8))) for n in range(1, WORDS)]
        phrases = pc.binary_join_element_wise(held[0], gaps[0], held[1], gaps[1], held[2], pa.scalar("", pa.large_string()))
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        cuts = [*starts.tolist(), len(part)]
        packed = [pack(phrases.slice(a, b - a), counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts], pa.int64()), pa.array([lang] * len(packed), pa.string()), pa.array(np.diff(cuts), pa.int32()), pa.array([p for p, _ in packed], pa.binary()), pa.array([n for _, n in packed], pa.int64())],
            names=["part", "lang", "entries", "run", "bytes"],
        )


def pack(phrases: pa.Array, counts: np.ndarray) -> tuple[bytes, int]:
    data, offsets = utf8(phrases)
    raw = counts.tobytes() + np.diff(offsets).astype("<u4").tobytes() + data[offsets[0] : offsets[-1]].tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def unpack(run: bytes, size: int, entries: int) -> tuple[pa.Array, np.ndarray]:
    raw = pa.decompress(run, size, codec="zstd", asbytes=True)
    offsets = np.zeros(entries + 1, np.int64)
    np.cumsum(np.frombuffer(raw, "<u4", entries, 8 * entries), out=offsets[1:])
    phrases = pa.LargeStringArray.from_buffers(entries, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[12 * entries :]))
    return phrases, np.frombuffer(raw, "<i8", entries)


def chunks(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Cut bytes behind separators, so that no piece is cut."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            inside = np.flatnonzero(_SEPARATOR[data[start:end]])
            while not len(inside) and end < len(data):
                inside = np.flatnonzero(_SEPARATOR[data[end : end + size]]) + (end - start)
                end += size
            end = start + int(inside[-1]) + 1 if len(inside) else len(data)
        yield data[start:end]
        start = end


def runs(docs: DataFrame, partitions: int) -> DataFrame:
    """Runs of the phrases of docs (lang, text), as each task's tries spill them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(partitions)
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for n, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, n)).to_pylist()
                data = np.frombuffer("\n".join(texts).encode(), np.uint8).copy()
                data[(data >= 65) & (data <= 90)] += 32
                for chunk in chunks(data, CHUNK):
                    counter.read(lang, chunk)
                    if counter.full():
                        yield from counter.spilled(HELD // 2)
        yield from counter.spilled()

    return docs.mapInArrow(count, "part long, lang string, entries int, run binary, bytes long")


def merged(least: int):
    """Runs sorted by (part, lang): the phrases of each that are frequent enough, and the root's number of words."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0

        def fold() -> None:
            nonlocal held, size
            table = pa.table({"phrase": pa.chunked_array([p for p, _ in held]), "n": pa.chunked_array([pa.array(c) for _, c in held])})
            table = table.group_by("phrase", use_threads=False).aggregate([("n", "sum")])
            held, size = [(table["phrase"].combine_chunks(), table["n_sum"].to_numpy())], len(table)

        def out() -> pa.RecordBatch:
            fold()
            phrases, n = held[0]
            frequent = pa.array((n >= least) | np.asarray(pc.equal(phrases, "")))
            phrases, n = phrases.filter(frequent), pa.array(n).filter(frequent)
            return pa.RecordBatch.from_arrays([pa.array([current[1]] * len(n), pa.string()), phrases.cast(pa.string()), n.cast(pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for part, lang, entries, run, size_ in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "entries", "run", "bytes")), strict=True):
                if (part, lang) != current:
                    if held:
                        yield out()
                    current, held, size = (part, lang), [], 0
                before = size
                held.append(unpack(run, size_, entries))
                size += entries
                if before and size > 2 * len(held[0][0]) + MERGED:
                    fold()
        if held:
            yield out()

    return merge


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, f) for phrases of one to three words that occur `least` times or more; the empty phrase has the number
    of all words of the lang."""
    whole = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = runs(whole, 1 + size // PARTITION)
    return found.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(merged(least), "lang string, phrase string, f long")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exactly, for counts up to 10^16."""
    a, l, r = (x.cast("decimal(19,0)") for x in (a, l, r))  # noqa: E741
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (a * a), l * r)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, explained: int = EXPLAINED, best: int = BEST) -> DataFrame:
    """Per lang its best phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; texts are split at `.,;:!?` and line ends, pieces at spaces and tabs. A null lang is `und`, a null text
    empty; repeated rows count each time. A phrase that occurs `least` times is scored by its lowest cut (the smaller first
    part of equals), and goes if a longer such phrase around it occurs in `explained` per cent of its places. Equal scores
    are ranked by count, then by the phrase's bytes. Further columns are not read."""
    counts = written(phrase_counts(docs, text, lang, least), "phrases")
    words = F.size(F.split("phrase", " "))
    phrases = counts.filter("phrase <> ''").withColumn("words", words)
    longer = phrases.filter("words = 3").withColumn("behind", F.substring_index("phrase", " ", -2)).withColumn("before", F.substring_index("phrase", " ", 2))
    around = longer.select("lang", F.explode(F.array("before", "behind")).alias("phrase"), F.col("f").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))

    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    pairs = phrases.filter("words = 2").join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < explained * F.col("f"), F.lit(True)))
    cuts = pairs.select("lang", "phrase", F.col("f").alias("a"), F.lit(1).alias("k"), first.alias("left"), last.alias("right")).unionByName(
        longer.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.array(
            F.struct(F.lit(1).alias("k"), first.alias("left"), F.col("behind").alias("right")), F.struct(F.lit(2).alias("k"), F.col("before").alias("left"), last.alias("right")),
        )))
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    scored = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a lang first, so that no task ranks a whole lang
    shares = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    shares = shares.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= best)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
