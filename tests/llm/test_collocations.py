import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, langs, least=10, best=2000):
    out = []
    counts = {}
    for text, lang in zip(texts, langs, strict=True):
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[()] += len(w)
            for n in (1, 2, 3):
                f.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q in ([] if len(p) == 3 else f) if len(q) == 3 and f[q] >= least and p in (q[:2], q[1:])]
            if any(100 * f[q] >= 50 * a for q in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, n, p, a, l, r, f[()], s) for n, (s, a, p, l, r) in enumerate(rows[:best], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "é", "Of", "of", "x\xa0y", "new york city", "in spite of"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += ["of of of of of", "", None, " \t ", "...", "new york city " * 30, "a" * 5000 + " b", "\x00 \x00 nul"]
    return texts, [rng.choice(["en", "en", "en", "de", None, "und", ""]) for _ in texts]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(documents, rows, clashing, seed):
    texts, langs = corpus(seed)
    found = C.collocations(clashing(documents(texts, langs=langs)))
    assert rows(found) == brute(texts, langs)


def test_bursts_spills_and_many_partitions_change_nothing(documents, rows, monkeypatch):
    for name, value in {"BURST": 40, "HELD": 600, "VOCABULARY": 15, "MERGED": 50, "CHUNK": 64, "PARTITION": 200, "DEALT": 3}.items():
        monkeypatch.setattr(C, name, value)
    texts, langs = corpus(2)
    found = C.collocations(documents(texts, langs=langs).repartition(5), best=7)
    assert rows(found) == brute(texts, langs, best=7)


def test_trie_bursts_between_words():
    rng = np.random.default_rng(1)
    trie, total = C.Trie(), Counter()
    C_burst = C.BURST
    C.BURST = 200
    try:
        for _ in range(30):
            path = rng.integers(1, 12, (3, 400))
            path[2, :100] = 0
            keys, counts = np.unique((path[0] << 42) | (path[1] << 21) | path[2] * rng.integers(1, 90, 400), return_counts=True)
            trie.add(keys, counts)
            total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    finally:
        C.BURST = C_burst
    assert trie.lows == sorted(trie.lows) and len(trie.lows) > 20
    assert all(low % (1 << 21) == 0 for low in trie.lows)  # between second words at the deepest
    for low, high, container in zip(trie.lows, [*trie.lows[1:], 1 << 63], trie.containers, strict=True):
        container.fold()
        assert len(container.keys) == len(set(container.keys.tolist())) and all(low <= k < high for k in container.keys.tolist())
    largest = max(c.size for c in trie.containers)
    before = len(trie)
    keys, counts = trie.spill(before - 1)
    assert len(keys) == largest and len(trie) == before - largest
    rest_keys, rest_counts = trie.spill(0)
    assert dict(zip(np.concatenate([keys, rest_keys]).tolist(), np.concatenate([counts, rest_counts]).tolist(), strict=True)) == dict(total) and len(trie) == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        r, l = rng.randint(1, 10**15), rng.randint(1, 10**15)  # noqa: E741
        rows.append((rng.randint(1, min(l, r)), l, r))
    rows += [(10**15, 10**15, 10**15), (1, 10**15, 10**15), (3, 3, 9)]
    found = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x["s"] == 1_000_000 * x["a"] ** 2 // (x["l"] * x["r"]) for x in found) and len(found) == len(rows)


def test_chunks_end_behind_separators():
    data = np.frombuffer(b"ab cd. e, ffffffffffffffffff gg\nh" + b"x" * 50 + b".z", np.uint8)
    parts = [p.tobytes() for p in C.chunks(data, 5)]
    assert b"".join(parts) == data.tobytes() and all(p[-1:] in b".,\n" for p in parts[:-1])


def test_no_rows_and_one_long_text(documents, rows):
    assert rows(C.collocations(documents([]))) == []
    assert rows(C.collocations(documents(["", None]))) == []
    texts = ["to be or not to be " * 20_000]
    assert rows(C.collocations(documents(texts))) == brute(texts, ["en"])
