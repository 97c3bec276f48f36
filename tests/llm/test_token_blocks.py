import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import token_blocks as T

tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", "plain words, and more.", " lead", "tail ", "two  spaces", "tab\t x \n y", "nbsp   x 　y", "é中文😀 it's 2024", "x" * 3000, "a<|endoftext|> b", "word " * 3000]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.integers(0, 8, n), np.full(n, 7), np.where(rng.random(n) < 0.03, 2**32 - 1, 5), np.arange(n) % 3 * 2**31):
        ids = ids.astype(np.uint32)
        cuts = sorted(rng.integers(0, n + 1, 4))
        held = T.Segment(T.segment([[part] for part in np.split(ids, cuts)]))
        assert (held.read(0, n) == ids).all() and held.firsts.tolist() == [0, *cuts, n]
        for _ in range(5):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (held.read(int(a), int(b)) == ids[a:b]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[::50] = 2**31
    assert len(T.block(ids)) < 1024 * 4 // 8 + 8 + 21 * 6 + 8


def test_pieces_encode_as_whole_texts(prose):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab c\n\t  é,.1'sIT ") for _ in range(rng.randint(0, 80))) for _ in range(300)] + [prose(80, 1)]
    for text, ids in zip(texts, T.Encoder(PATH).encode_all(pa.array(texts)), strict=True):
        assert ids.tolist() == library(text), text[:100]


def test_cache_starts_over_when_full(monkeypatch, prose):
    monkeypatch.setattr(T, "KEPT", 40)
    use = T.Encoder(PATH)
    for k in range(4):
        texts = [prose(100, k), "y" * 200 + " " + "z" * 200]
        assert [x.tolist() for x in use.encode_all(pa.array(texts))] == [library(t) for t in texts]


def test_files_hold_all_documents_in_order(documents, rows, clashing, monkeypatch, spark):
    monkeypatch.setattr(T, "SEGMENT", 300)  # workers that were forked before keep the default; both orders must hold
    texts = [t.replace("<|endoftext|>", "") for t in TEXTS] + [None, "same", "same"]
    ids = [*range(len(TEXTS) - 1, -1, -1), 70, 50, 50]
    segments = T.write(clashing(documents(texts, ids=ids)), PATH)
    at, expected = 0, []
    for n, text in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0], x[1] or "")):
        tokens = [*library(text or ""), 2]
        expected.append((n, at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        at += len(tokens)
    assert rows(T.checked(segments), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    read = {r["start"]: r["ids"] for r in T.read(segments).collect()}
    assert sum(map(len, read.values())) == at and all(x[-1] == 2 for x in read.values())
    assert rows(T.checked(T.write(documents([]), PATH))) == []
    assert rows(T.checked(T.write(documents(["a"], ids=[None]), PATH)), "doc_id", "start") == [(None, 0)]


def test_places_are_narrow_unless_there_are_too_many():
    sizes, at = np.array([2, 0, 3]), np.array([2, 0, 1, 2], np.int32)
    places, stops = T.positions(sizes, at)
    assert places.dtype == np.int32 and places.tolist() == [2, 3, 4, 0, 1, 2, 3, 4] and stops.tolist() == [3, 5, 5, 8]
    assert [x.tolist() for x in T.positions(np.zeros(0, np.int64), np.zeros(0, np.int32))] == [[], []]


def test_only_pieces_that_are_not_known_are_kept_anew():
    use, text = T.Encoder(PATH), pa.array(["some plain words, and more."])
    first = use.encode_all(text)[0].tolist()

    class Kept(dict):
        def update(self, items):
            assert not list(items)

    use.young = Kept(use.young)
    assert use.encode_all(text)[0].tolist() == first == library("some plain words, and more.")


def test_pieces_are_not_handled_one_by_one():
    words, calls = [f"w{k}x{k * 7919 % 1000}" for k in range(20_000)], []
    use, text, before = T.Encoder(PATH), " ".join(words), sys.getprofile()
    sys.setprofile(lambda *call: calls.append(call[1]))
    try:
        ids = use.encode_all(pa.array([text]))[0]
    finally:
        sys.setprofile(before)
    assert len(calls) < len(words) / 2  # of Python and of functions in C
    assert len(use.young["words"]) == len(words) and sum(use.young[c].nbytes for c in ("words", "sizes", "ids")) < 64 * len(words)
    assert ids.tolist() == library(text)


def test_pieces_of_the_older_generation_and_long_ones(monkeypatch, prose):
    monkeypatch.setattr(T, "KEPT", 40)
    use, texts = T.Encoder(PATH), [prose(100, 1), "few words, " + "z" * 200 + " end.", prose(100, 1), "few words, " + "z" * 200 + " end."]
    for text in texts:
        assert use.encode_all(pa.array([text, "few words"]))[0].tolist() == library(text)
    assert "z" * 200 not in use.young["words"].to_pylist() + use.old["words"].to_pylist()


def test_pieces_that_can_not_be_cut_apart_are_encoded_alone(monkeypatch, prose):
    monkeypatch.setattr(T, "GROUP", 7)
    use, text = T.Encoder(PATH), prose(80, 2)
    use.width[np.unique(library(text))[::5]] += 1  # as if tokens reached over the ends of some pieces
    assert use.encode_all(pa.array([text, ""]))[0].tolist() == library(text)


def test_tasks_give_memory_back(documents, rows, monkeypatch):
    used, tidied = [], T.tidied
    monkeypatch.setattr(T, "tidied", lambda work: used.append(work.__name__) or tidied(work))
    assert len(rows(T.checked(T.write(documents(["a b", None]), PATH)))) == 2
    assert used == ["encode", "decode"]
