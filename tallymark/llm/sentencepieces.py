"""SentencePiece encoding and decoding by streaming Viterbi search.

The lattice has a boundary after each character and an edge for each piece. Going left to right, a boundary keeps its
best last piece as a backpointer. No piece is longer than `longest`, so only the last `longest` boundaries can still be
extended: as soon as all their backpointer paths run through one boundary, the ids before it are committed and
forgotten, and memory stays bounded for any length of text.

Unigram models score a path by the sum of its pieces. Merge (BPE) models have one valid path: the search admits an edge
only where the piece before it and its own piece stay apart under the model's merges, which is exactly when neither
boundary would have been merged away, so each boundary has one surviving last piece and the ids are the model's own.

No piece has a word start after another character, so the boundary before each word is one where all paths meet. Words
are therefore searched once per worker, thousands side by side in arrays, and their ids looked up afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import tidied, whole_text
from tallymark.llm.shingles import pieces as pieces_of
from tallymark.llm.shingles import utf8

#: The mark for a space, and what kinds of pieces and models are in the file format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, MERGES = 1, 2
#: Words of which a worker keeps the ids, the longest such word, and pairs of pieces that it keeps.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 250_000, 48, 400_000
#: Places in which a worker notes which words it has met once.
NOTED = 1 << 22
#: Texts encoded together and their bytes, unless one text is longer, and words searched side by side.
PART, PART_BYTES, BESIDE = 2048, 1 << 22, 32_768
#: No piece ends so.
MISSING = -2
#: Texts whose words cannot be looked up one by one: runs of spaces, or the mark itself.
UNSPLIT = f"  |^ |{SPACE}"


class Table:
    """64-bit keys to ids, looked up many at a time by open addressing."""

    def __init__(self, values: dict[int, int]):
        self.bits = max(4, (4 * len(values)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, MISSING, np.int32)
        keys, ids = np.array(list(values), np.uint64), np.array(list(values.values()), np.int32)
        at = self.places(keys)
        while len(keys):
            first = np.unique(at, return_index=True)[1]
            first = first[self.values[at[first]] == MISSING]
            self.keys[at[first]], self.values[at[first]] = keys[first], ids[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids, at = keys[rest], ids[rest], (at[rest] + 1) % len(self.keys)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The ids of keys, or MISSING."""
        at = self.places(keys)
        out, held = self.values[at], self.keys[at]
        open_ = np.flatnonzero((held != keys) & (out > MISSING))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            out[open_], held = self.values[at[open_]], self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (out[open_] > MISSING)]
        return out


class Pieces:
    """A model's pieces and the search over them."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.ids = {p: n for n, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): n for n, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((n for n, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.unknown_score = min((self.scores[n] for n in self.ids.values()), default=0.0) - 10
        self.longest = max(map(len, self.ids), default=1)
        # what a piece can end with -> its id if it is a piece, else -1
        self.known = {p[-k:]: -1 for p in self.ids for k in range(1, len(p) + 1)} | self.ids
        self.cut_at_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        # the words of late, and those before them: what is not met again goes
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.noted, self.n_noted = np.zeros(NOTED, bool), 0
        # for many words at once: which pairs of ids stay apart, and what pieces can end with, by its hash
        self.strings, self.sizes, self.apart = [p for p, _, _ in pieces], np.array([len(p) for p, _, _ in pieces]), {}
        self.pairs_tabled = 0
        self.pair_table = Table({})
        self.powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(self.longest)], np.uint64)
        self.suffixes = Table({self.hash(p): n for p, n in self.known.items()})
        self.shown = [self._shown(p, t) for p, _, t in pieces]

    def hash(self, piece: str) -> int:
        return sum(ord(c) * int(p) for c, p in zip(reversed(piece), self.powers, strict=False)) % 2**64

    @staticmethod
    def _shown(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces ends with just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def merged(self, text: str) -> list[str]:
        """Merge a short run of characters: always the best-scored neighbours, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                n = ids.get(parts[k] + parts[k + 1])
                if n is not None and (best is None or scores[n] > best):
                    best, at = scores[n], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def step(self, text: str, i: int, back: dict[int, int], score: dict[int, float]) -> None:
        """Find the best piece that ends at boundary i: its start is the backpointer."""
        get, starts, k = self.known.get, [], i - 1
        while k >= 0:
            n = get(text[k:i])
            if n is None:
                break
            if n >= 0:
                starts.append(k)
            k -= 1
        if self.kind == MERGES:
            pairs = self.pairs
            for k in reversed(starts):
                before = back[k]
                if before < 0:
                    back[i] = k
                    return
                left, right = text[before:k], text[k:i]
                apart = pairs.get((left, right))
                if apart or apart is None and self.stay_apart(left, right):
                    back[i] = k
                    return
        elif starts:
            total, best = max((score[k] + self.scores[get(text[k:i])], -k) for k in starts)
            back[i], score[i] = -best, total
            return
        back[i] = i - 1  # a character that no piece has
        score[i] = score.get(i - 1, 0.0) + self.unknown_score

    def search(self, text: str) -> Iterator[list[int]]:
        """Ids of a text with its spaces marked, a committed run at a time."""
        back, score, committed = {0: -1}, {0: 0.0}, 0
        for i in range(1, len(text) + 1):
            self.step(text, i, back, score)
            if i - committed >= 4 * self.longest:
                meet = self._meeting(back, i, committed)
                if meet > committed:
                    yield self._ids(text, back, meet, committed)
                    # what is left is the window, from the boundary that its paths begin at
                    back = {k: v for k, v in back.items() if k >= meet}
                    score = {k: v for k, v in score.items() if k >= meet}
                    committed = meet
        if len(text) > committed:
            yield self._ids(text, back, len(text), committed)

    def learn(self, words: list[str]) -> None:
        """Search words that follow a space. At each word's start all paths meet, so many words are searched side by side,
        a boundary of each at a time."""
        if self.kind != MERGES:
            for word in words:
                self.words[word] = self.encode_marked(SPACE + word).tobytes()
            return
        for k in range(0, len(words), BESIDE):
            self._learn(words[k : k + BESIDE])

    def _learn(self, words: list[str]) -> None:
        words = sorted(words, key=len, reverse=True)
        text = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) + 1 for w in words])
        starts = np.cumsum(sizes) - sizes
        # pieces that end at each character: what it and those before it hash to, as long as pieces can end so
        room = np.arange(len(text)) - np.repeat(starts, sizes) + 1
        ending, alive, h = [], np.arange(len(text)), np.zeros(len(text), np.uint64)
        for size in range(1, self.longest + 1):
            alive = alive[room[alive] >= size]
            h[alive] += text[alive - size + 1] * self.powers[size - 1]
            found = self.suffixes.get(h[alive])
            alive = alive[found > MISSING]
            if not len(alive):
                break
            ids = np.full(len(text), -1, np.int32)
            ids[alive] = found[found > MISSING]
            ending.append(ids)
        piece = np.full(len(text), -1, np.int32)
        total = len(self.scores)
        for j in range(int(sizes[0])):
            at = starts[: np.searchsorted(-sizes, -j, "left")] + j  # words of more than j characters
            for size in range(min(j + 1, len(ending)), 0, -1):
                ids = ending[size - 1][at]
                fits = ids >= 0
                here, ids = at[fits], ids[fits]
                if size <= j and len(here):
                    before = piece[here - size]
                    # behind a character of no piece, the right piece has only itself to hold together
                    stays = self.staying((before.astype(np.int64) + 1) * total + ids)
                    here, ids = here[stays], ids[stays]
                piece[here] = ids
                at = at[piece[at] < 0]
        size = np.where(piece >= 0, self.sizes[piece], 1)
        # back from each word's end
        rounds, word, at = [], np.arange(len(words)), starts + sizes - 1
        odd = set()
        while len(word):
            ids = piece[at]
            odd.update(word[ids < 0].tolist())
            rounds.append((word, ids, text[at]))
            at = at - size[at]
            going = at >= starts[word]
            word, at = word[going], at[going]
        order = np.argsort(np.concatenate([w for w, _, _ in rounds][::-1]), kind="stable")
        found = np.concatenate([i for _, i, _ in rounds][::-1])[order].astype(np.int32)
        letter = np.concatenate([c for _, _, c in rounds][::-1])[order]
        counts = np.zeros(len(words) + 1, np.int64)
        for w, _, _ in rounds:
            counts[1:][w] += 1
        cuts, raw = np.cumsum(counts).tolist(), found.tobytes()
        for n, w in enumerate(words):
            a, b = cuts[n], cuts[n + 1]
            if n in odd:  # a character that no piece has
                ids = [x for i, c in zip(found[a:b].tolist(), letter[a:b].tolist(), strict=True) for x in ([i] if i >= 0 else self.id_or_bytes(chr(c)))]
                self.words[w] = np.array(ids, np.int32).tobytes()
            else:
                self.words[w] = raw[4 * a : 4 * b]
        if len(self.apart) > KEPT_PAIRS:  # start over
            self.apart, self.pairs_tabled, self.pair_table = {}, 0, Table({})
        if len(self.apart) > 1.1 * self.pairs_tabled:
            self.pairs_tabled = len(self.apart)
            self.pair_table = Table(self.apart)

    def forget(self, words: list[str]) -> None:
        """Of words met once in some texts, keep those met before: most others never come again."""
        at = np.fromiter(map(hash, words), np.int64, len(words)) % len(self.noted)
        for k in np.flatnonzero(~self.noted[at]).tolist():
            del self.words[words[k]]
        self.n_noted += len(words)
        if self.n_noted > len(self.noted) // 2:  # start over before most words seem met
            self.noted[:], self.n_noted = False, len(words)
        self.noted[at] = True

    def staying(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs of ids, (left + 1) * number of pieces + right, stay apart."""
        known = self.pair_table.get(pairs.astype(np.uint64))
        unknown = np.flatnonzero(known == MISSING)
        if len(unknown):
            new, where = np.unique(pairs[unknown], return_inverse=True)
            found = [self.apart.get(p) for p in new.tolist()]
            for k, stays in enumerate(found):
                if stays is None:
                    left, right = divmod(int(new[k]), len(self.scores))
                    parts = [self.strings[left - 1]] * (left > 0) + [self.strings[right]]
                    found[k] = self.apart[int(new[k])] = int(self.merged("".join(parts)) == parts)
            known[unknown] = np.array(found, np.int32)[where]
        return known == 1

    def _meeting(self, back: dict, i: int, committed: int) -> int:
        """The last boundary that the paths of all boundaries in the window share."""
        alive = set(range(max(committed, i - self.longest + 1), i + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(max(committed, back[last]))
        return alive.pop()

    def _ids(self, text: str, back: dict, end: int, start: int) -> list[int]:
        out = []
        while end > start:
            first = back[end]
            out.append((first, end))
            end = first
        return [n for first, end in reversed(out) for n in self.id_or_bytes(text[first:end])]

    def id_or_bytes(self, piece: str) -> list[int]:
        n = self.ids.get(piece)
        if n is not None:
            return [n]
        return [self.bytes.get(b, self.unknown) for b in piece.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        marked = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return self.encode_marked(marked)

    def encode_marked(self, marked: str) -> np.ndarray:
        chunks = re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", marked) if self.cut_at_words else [marked]
        return np.array([n for chunk in chunks for run in self.search(chunk) for n in run], np.int32)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a column one after another, and the offsets of its rows in them.

        Words between single spaces are looked up; those not met before are searched together."""
        plain = np.zeros(len(texts), bool)
        if self.cut_at_words and self.dummy_prefix:
            plain = ~np.asarray(pc.match_substring_regex(texts, UNSPLIT)) & (np.asarray(pc.binary_length(texts)) > 0)
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        found = split.flatten().dictionary_encode()
        names = found.dictionary.to_pylist()
        blobs = list(map(self.words.get, names))
        for k in [k for k, b in enumerate(blobs) if b is None]:
            if (blob := self.older.get(names[k])) is not None:
                blobs[k] = self.words[names[k]] = blob
        unknown = [k for k, b in enumerate(blobs) if b is None]
        short = [names[k] for k in unknown if len(names[k]) <= KEPT_LENGTH]
        if len(self.words) + len(short) > KEPT_WORDS // 2:
            self.older, self.words = self.words, {}
        words = self.words
        self.learn(short)
        for k in unknown:
            blobs[k] = words[names[k]] if len(names[k]) <= KEPT_LENGTH else self.encode_marked(SPACE + names[k]).tobytes()
        often = np.bincount(np.asarray(found.indices), minlength=len(names)) > 1
        self.forget([names[k] for k in unknown if len(names[k]) <= KEPT_LENGTH and not often[k]])
        size = np.array([len(b) >> 2 for b in blobs], np.int64)
        flat, starts = np.frombuffer(b"".join(blobs), np.int32), np.cumsum(size) - size
        at = np.asarray(found.indices)
        ends = np.concatenate([[0], np.cumsum(size[at])])  # of the ids of each word of the texts
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], size[at])] if len(at) else np.zeros(0, np.int32)
        cuts = ends[np.concatenate([[0], np.cumsum(np.asarray(split.value_lengths()))]).astype(np.int64)]
        if plain.all():
            return ids, cuts
        rows = iter(np.split(ids, cuts[1:-1])) if plain.any() else iter(())
        rows = [next(rows) if p else self.encode(t) for p, t in zip(plain.tolist(), texts.to_pylist(), strict=True)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Text of some ids: bytes of the pieces, without the prefix that encoding added."""
        shown = self.shown
        text = b"".join([shown[n] for n in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    """A model file's pieces. The file has to be at this path on each executor."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    if proto.trainer_spec.model_type not in (UNIGRAM, MERGES):
        raise ValueError("only unigram and merge models have pieces to search")
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("texts are encoded as they are: the model must not normalise them")
    return Pieces([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type, proto.normalizer_spec.add_dummy_prefix)


def parts(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes of text."""
    _, offsets = utf8(batch.column(text))
    for first in range(0, len(batch), PART):
        for start, end in pieces_of(offsets[first : first + PART + 1], PART_BYTES):
            yield batch.slice(first + start, end - start)


def listed(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def encoded(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids. Null counts as empty, which has no ids. Further columns are not read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for batch in batches:
            # a batch of long texts goes out in parts
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed(*pieces.encode_column(part.column("text")))], names=["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).mapInArrow(tidied(encode), f"doc_id {kind}, ids array<int>")


def decoded(ids: DataFrame, model_path: str, doc_id: str = "doc_id", column: str = "ids") -> DataFrame:
    """One row per row of ids: doc_id, text. Null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for batch in batches:
            for start in range(0, len(batch), PART):
                part = batch.slice(start, PART)
                texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = ids.schema[doc_id].dataType.simpleString()
    return ids.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("ids")).mapInArrow(tidied(decode), f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, ids, n_ids, text_sha256 of the decoded text, same (it is the text again).

    A text that has the space mark itself decodes to one with a space there, as the model defines it."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for batch in batches:
            for part in parts(batch):
                texts = part.column("text").to_pylist()
                ids, offsets = pieces.encode_column(part.column("text"))
                back = [pieces.decode(ids[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in back]
                same = [a == b.replace(SPACE, " ") for a, b in zip(back, texts, strict=True)]
                columns = [pa.array(np.diff(offsets), pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed(ids, offsets), *columns], names=["doc_id", "ids", "n_ids", "text_sha256", "same"])

    kind = docs.schema[doc_id].dataType.simpleString()
    whole = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    return whole.mapInArrow(tidied(both), f"doc_id {kind}, ids array<int>, n_ids long, text_sha256 string, same boolean")
