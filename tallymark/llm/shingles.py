"""Word shingles of Arrow text columns as 64-bit hashes, for a whole batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240501)
#: A random value per byte, an odd base with its inverse, and an odd factor per place in a shingle.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Bytes of text worked on at once, unless one text is longer.
CHUNK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows in them; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about the given number of bytes."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (run of non-blank bytes) of the rows, and the offsets of the rows in them."""
    base, data = int(offsets[0]), data[offsets[0] : offsets[-1]]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[:-1] - base
    cuts = cuts[cuts < n]
    first[cuts] = word[cuts]  # a word ends with its row
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:] - base - 1
    ends = ends[ends >= 0]
    last[ends] = word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power, out=sums[1:])
    del power
    # dividing by the power at the start makes the hash independent of the place
    inverse = np.full(n, _INVERSE, np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    hashes = mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets - base).astype(np.int64)


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `width` words; one of all its words if it has fewer."""
    data, offsets = utf8(texts)
    for start, end in pieces(offsets):
        words, rows = word_hashes(data, offsets[start : end + 1])
        runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            runs += words[k : k + len(runs)] * _PLACE[k]
        runs = mixed(runs)
        for i in range(end - start):
            low, high = rows[i], rows[i + 1]
            if high - low >= width:
                yield np.unique(runs[low : high - width + 1])
            elif high > low:
                # the number of words is part of the hash, so a short text never equals a run of a longer one
                yield mixed(np.array([(words[low:high] * _PLACE[: high - low]).sum() + np.uint64(high - low)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
