import hashlib

import numpy as np
import pytest

from tallymark.llm import quartile_digest as Q


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (n, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        own, changed, its = (Q.digest(t.encode()) for t in (text, new, following))
        out.append((n, len(text), hashlib.sha256(new.encode()).hexdigest(), Q.shown(own), Q.shown(changed), Q.likeness(own, changed), Q.likeness(own, its)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_equals_brute_force(documents, rows, clashing, prose):
    texts = [None, "", "a", "ab", "é😀x", "x" * 200_000, prose(300, 1), prose(300, 1), "same", "same"] + [prose(50 + k, k) for k in range(60)]
    ids = [70, 5, 9, 3, None, 8, 1, 2, 4, 4] + list(range(100, 160))
    found = Q.with_next(clashing(documents(texts, ids=ids)).repartition(7))
    assert rows(found, *COLUMNS) == brute(list(zip(ids, texts, strict=True)))


@pytest.mark.parametrize("texts", [[], ["alone"], ["one", "two"]])
def test_small_tables(documents, rows, texts):
    assert rows(Q.with_next(documents(texts)), *COLUMNS) == brute(list(enumerate(texts)))


def test_likeness_falls_with_edits(prose):
    text = prose(600, 1)
    words = text.split()
    whole = Q.digest(text.encode())
    near = [Q.likeness(whole, Q.digest(" ".join(words[: 600 - n] + prose(n, 9).split()).encode())) for n in (0, 6, 60, 300)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.8
    assert Q.likeness(whole, Q.digest("другой текст на другом языке, совсем иной ".encode() * 40)) < 0.3
    assert Q.likeness(Q.digest(b""), whole) >= 0


def test_hexadecimal_form_is_read_back(prose, documents, rows):
    codes = Q.digest(prose(100, 2).encode())
    assert (Q.parsed(Q.shown(codes)) == codes).all() and len(np.unique(codes[1:])) == 4
    assert rows(Q.fingerprints(documents(["t", None, "t"])))[0][1] == Q.shown(Q.digest(b"t"))
