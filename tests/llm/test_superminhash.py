import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import superminhash
from tallymark.llm.shingles import shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set())
    return out


def brute(texts):
    sets = sets_of(texts)
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted(((k, len(sets[k]), top(k), top(k) == k) for k in range(len(sets))), key=repr)


def corpus(prose, seed, families=25):
    rng = random.Random(seed)
    texts = []
    for k in range(families):
        words = prose(rng.choice([4, 5, 6, 9, 15, 60, 200]), 1000 * seed + k).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 20))):
                new[rng.randrange(len(new))] = "edit" + str(rng.randint(0, 99))
            texts.append(rng.choice([" ", "\n", "  "]).join(new).upper() if rng.random() < 0.2 else " ".join(new))
    texts += ["", None, " \n", "few words", "Few WORDS", "few words here", "one", "ONE", "É one", "é one", "a b a b a b", "a b a"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(documents, rows, clashing, prose, seed):
    texts = corpus(prose, seed)
    found = superminhash.near_duplicates(clashing(documents(texts)))
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute(texts)


def test_chains_and_stragglers_of_a_large_group(documents, rows, prose, monkeypatch):
    """Members that the hub doesn't show are found beside it, in blocks."""
    monkeypatch.setattr(superminhash, "PART_ROWS", 8)
    monkeypatch.setattr(superminhash, "BLOCK_ROWS", 8)
    words = prose(120, 3).split()
    texts = [" ".join(words[:k] + [f"edit{k}"] + words[k + 1 :]) for k in range(80)] + [" ".join(words)] * 9
    for step in range(1, 12):  # a chain that moves away, and a second group just out of reach of the first
        texts.append(" ".join([f"chain{k}" for k in range(5 * step)] + words[5 * step :]))
    texts += [" ".join([f"far{k}" for k in range(13)] + words[13:60] + [f"far{n}"] + words[61:]) for n in range(40)]
    assert rows(superminhash.near_duplicates(documents(texts))) == brute(texts)


def test_no_node_is_lost_beside_its_hub(documents, rows, prose, monkeypatch):
    """With one value to a band most sets meet: every link then comes from hubs and blocks."""
    monkeypatch.setattr(superminhash, "BLOCK_ROWS", 4)
    rng = random.Random(4)
    words = prose(30, 8).split()
    texts = [" ".join(w if rng.random() > 0.12 else f"e{rng.randint(0, 3)}" for w in words) for _ in range(60)]
    expected = brute(texts)
    assert len({c for _, _, c, _ in expected}) > 2
    assert rows(superminhash.near_duplicates(documents(texts), values=24, band=1)) == expected


def test_signature_is_the_definition():
    """Element by element, rank by rank, without early stopping."""
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 3, 7, 40, 300, 2000)] + [np.zeros(0, np.uint64)]
    m = 16

    def whole(found):
        least = [2**32 - 1] * m
        for x in found:
            places = list(range(m))
            for rank in range(m):
                draw = int(superminhash.mixed(np.array([(int(x) + (rank + 1) * superminhash._STEP) % 2**64], np.uint64))[0])
                k = rank + ((draw >> 32) * (m - rank) >> 32)
                places[rank], places[k] = places[k], places[rank]
                least[places[rank]] = min(least[places[rank]], (rank << 25) | (draw & ((1 << 25) - 1)))
        return least

    assert superminhash.signatures(sets, m).tolist() == [whole(s) for s in sets]


def test_estimates_vary_less_than_independent_hashes():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(300):
        x = rng.integers(0, 2**63, 12, dtype=np.uint64)
        a, b = superminhash.signatures([x[:10], x[2:]], 64)
        errors.append((a == b).mean() - 8 / 12)
    independent = (8 / 12) * (4 / 12) / 64
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.6 * independent


def test_lowered_is_ascii_only():
    texts = pa.array(["skip", "ABC É Z", None, "İ x"]).slice(1)
    assert superminhash.lowered(texts).to_pylist() == ["abc É z", "", "İ x"]
    assert len(next(shingles(superminhash.lowered(pa.array(["A b A B"])), 2))) == 2


def test_repeated_rows_null_ids_and_no_rows(documents, rows, prose):
    text = prose(50, 1)
    found = superminhash.near_duplicates(documents([text, text, text + " x", None, ""], ids=[3, 3, None, None, 3]))
    assert rows(found, "doc_id", "component_id", "kept") == sorted([(3, 3, True), (3, 3, True), (None, 3, False), (None, None, True), (3, 3, True)], key=repr)
    assert rows(superminhash.near_duplicates(documents([]))) == []
    assert rows(superminhash.near_duplicates(documents([""])), "n_shingles", "component_id") == [(0, 0)]
    long = prose(60_000, 2)
    assert {r[1] for r in rows(superminhash.near_duplicates(documents([long, long + " end"])), "doc_id", "component_id")} == {0}
