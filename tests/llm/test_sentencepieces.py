import random

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import sentencepieces as S

tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", " ", "  a  b ", "plain words, and more.", "tab\tline\nend ", "▁ mark", "é中文😀 ok", "x" * 5000, "hé llo " * 2000, "\x00 nul", "&nbsp;  end"]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encode_all(pieces, texts):
    ids, offsets = pieces.encode_column(pa.array(["skip", *texts]).slice(1))
    assert len(offsets) == len(texts) + 1 and offsets[-1] == len(ids)
    return np.split(ids, offsets[1:-1])


def test_ids_are_those_of_the_model(library, prose):
    rng = random.Random(2)
    texts = TEXTS + [prose(60, k) for k in range(40)]
    texts += ["".join(rng.choice("abcthei on  \n▁éß中😀129.,-") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    pieces = S.model(PATH)
    for text, ids, expected in zip(texts, encode_all(pieces, texts), library.encode(texts), strict=True):
        assert ids.tolist() == pieces.encode(text).tolist() == expected
        assert pieces.decode(ids) == library.decode(expected) == text.replace("▁", " ")


def test_commits_within_a_bounded_window(library):
    rng = random.Random(3)
    text = "▁" + "".join(rng.choice("abcdetheionr") for _ in range(20_000))
    runs = list(S.model(PATH).search(text))
    assert [n for run in runs for n in run] == library.encode(text[1:])
    assert len(runs) > 100 and max(map(len, runs)) < 100


def test_unigram_scores_equal_a_search_of_all_paths():
    rng = random.Random(4)
    pieces = [("<unk>", 0.0, S.UNKNOWN)] + [(p, -rng.uniform(1, 9), S.NORMAL) for p in {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)} | set("ab▁")]
    model = S.Pieces(pieces, S.UNIGRAM)
    for _ in range(200):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 40)))
        marked = "▁" + text.replace(" ", "▁")
        best = {0: 0.0}
        for end in range(1, len(marked) + 1):
            options = [best[k] + model.scores[model.ids[marked[k:end]]] for k in range(end) if marked[k:end] in model.ids]
            best[end] = max(options, default=best[end - 1] + model.unknown_score)
        score = sum(model.unknown_score if n == 0 else model.scores[n] for n in model.encode(text).tolist())
        assert score == pytest.approx(best[len(marked)])


def test_cache_starts_over_when_full(monkeypatch, prose):
    monkeypatch.setattr(S, "KEPT_WORDS", 50)
    pieces = S.model.__wrapped__(PATH)
    for k in range(5):
        texts = [prose(100, k), prose(80, 10 + k)]
        for text, ids in zip(texts, encode_all(pieces, texts), strict=True):
            assert ids.tolist() == pieces.encode(text).tolist()


def test_words_that_come_once_are_not_kept(monkeypatch):
    """A worker's memory holds words that come again, not all that it has met; their ids are the same."""
    monkeypatch.setattr(S, "NOTED", 1 << 14)
    pieces = S.model.__wrapped__(PATH)
    for k in range(20):
        texts = [" ".join(["again", f"twice{k}", f"twice{k}", *(f"once{k}x{n}" for n in range(200))]), "next again"]
        for text, ids in zip(texts, encode_all(pieces, texts), strict=True):
            assert ids.tolist() == pieces.encode(text).tolist()
    assert {"again", "twice0", "twice19", "next"} <= set(pieces.words) and len(pieces.words) < 1200
    assert len(pieces.pair_table.keys) <= 8 * len(pieces.apart)


def test_tables(documents, rows, clashing):
    docs = clashing(documents(TEXTS + [None, "same", "same"], ids=[*range(len(TEXTS)), None, 50, 50]))
    found = S.round_trip(docs, PATH)
    assert found.filter("not same").count() == 0 and found.count() == len(TEXTS) + 3
    back = S.decoded(S.encoded(docs, PATH), PATH)
    assert rows(back, "text") == sorted([(t.replace("▁", " "),) for t in TEXTS + ["", "same", "same"]], key=repr)
    assert rows(S.round_trip(documents([]), PATH)) == [] and rows(S.decoded(S.encoded(documents([]), PATH), PATH)) == []
    assert np.array_equal(S.model(PATH).encode(""), [])


def test_worker_keeps_bounded_words_and_pairs(monkeypatch):
    """Words met again of late stay when others go, pairs start over; the ids are the same."""
    monkeypatch.setattr(S, "KEPT_WORDS", 400)
    monkeypatch.setattr(S, "KEPT_PAIRS", 300)
    pieces = S.model.__wrapped__(PATH)
    for k in range(30):
        texts = [" ".join(["again", *(f"twice{k}x{n} twice{k}x{n}" for n in range(60))]), "next again"]
        for text, ids in zip(texts, encode_all(pieces, texts), strict=True):
            assert ids.tolist() == pieces.encode(text).tolist()
        assert len(pieces.words) + len(pieces.older) <= 400 and len(pieces.pairs) <= 300 and len(pieces.apart) <= 300
        assert k == 0 or {"again", "next"} <= set(pieces.words) | set(pieces.older)  # met twice


def test_long_texts_are_encoded_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(S, "PART", 5)
    monkeypatch.setattr(S, "PART_BYTES", 100)
    texts = ["x" * n for n in [10, 20, 300, 0, 90, 20, 1, 1, 1, 1, 1, 1, 1, 1]] + [None, "é" * 60]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]).slice(1)
    found = list(S.parts(batch))
    assert [n for part in found for n in part.column("doc_id").to_pylist()] == [*range(1, len(texts))]
    for part in found:
        held = sum(len((t or "").encode()) for t in part.column("text").to_pylist())
        assert len(part) <= 5 and (held <= 100 or len(part) == 1)
    assert list(S.parts(batch.slice(0, 0))) == []
