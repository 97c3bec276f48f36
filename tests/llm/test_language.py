import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import language as L

SOUNDS = {"en": "the ing tion wh ould", "de": "der sch ung ein äu", "fr": "eau ent qui ois é", "es": "ción los que ñ ado", "xx": "zk qv wyx jj uq"}


def sentence(lang, rng, n=30):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def table(documents):
    rng = random.Random(1)
    langs = [rng.choice(list(SOUNDS)) for _ in range(400)]
    return documents([sentence(c, rng) for c in langs], langs=langs)


def test_held_out_rows_are_told_apart(table):
    fit = L.fitted(table, L.remainder() != 0)
    assert fit.families == ["Germanic", "Romance", "xx"] and set(fit.within) == {("de", "en"), ("es", "fr")}
    held = table.filter(L.remainder() == 0)
    found = L.predicted(held, fit, keep=("lang",)).collect()
    assert len(found) == held.count() > 40 and all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in found)


def test_held_out_labels_and_other_columns_do_not_matter(table, rows):
    scrambled = table.withColumn("lang", F.when(L.remainder() == 0, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a = L.predicted(table, L.fitted(table, L.remainder() != 0))
    b = L.predicted(scrambled, L.fitted(scrambled, L.remainder() != 0))
    assert rows(a) == rows(b)


def test_the_sample_is_bounded(table):
    fit = L.fitted(table, L.remainder() != 0, sample=50)
    assert L.predicted(table, fit, keep=("lang",)).filter("lang <> lang_pred").count() < 40


@pytest.mark.parametrize("seed", range(3))
def test_a_language_of_repeated_rows_is_learned(documents, seed):
    rng = random.Random(seed)
    texts = [sentence(c, rng) for c in ("en", "de") for _ in range(40)] + [sentence("xx", rng)] * 5000
    docs = documents(texts, langs=["en"] * 40 + ["de"] * 40 + ["xx"] * 5000)
    fit = L.fitted(docs, F.lit(True), sample=60)
    assert "xx" in fit.families
    assert L.predicted(docs, fit, keep=("lang",)).filter("lang = 'xx' and lang_pred <> 'xx'").count() == 0


@pytest.mark.parametrize(("languages", "sample"), [(130, 260), (130, 130), (130, 100)])
def test_many_languages_stay_within_the_bound(documents, monkeypatch, languages, sample):
    texts = [f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k)} {n}" for k in range(languages) for n in range(3 + (k < 100)) for _ in range(2)]
    langs = [f"l{k:03}" for k in range(languages) for n in range(3 + (k < 100)) for _ in range(2)]
    rows = []
    monkeypatch.setattr(L, "_against", lambda ours, others: rows.append(sum(map(len, ours)) + sum(map(len, others))) or np.zeros(L.FEATURES + 1, np.float32))
    fit = L.fitted(documents(texts, langs=langs), F.lit(True), sample=sample)
    assert len(fit.families) == min(languages, sample) and max(rows) <= sample
    if sample < languages:
        assert fit.families == [f"l{k:03}" for k in range(100)]


def brute_prediction(fit, text):
    """The same prediction by dictionaries of n-grams and plain sums."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    folded = [32, *(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else 32 if b < 128 else b for b in text.encode()), 32]
    counts = {}
    for n in (1, 2, 3):
        for k in range(len(folded) - n + 1):
            code = 0
            for b in folded[k : k + n]:
                code = (code * 257 + b) % 2**32
            slot = ((code + n - 1) * 2654435761) % 2**32 >> 20
            counts[slot] = counts.get(slot, 0) + 1
    norm = sum(counts.values()) ** 0.5

    def margin(w):
        return sum(float(w[s]) * c**0.5 / norm for s, c in counts.items()) + float(w[-1])

    def sure(m):
        return 1 / (1 + 2.718281828459045 ** (-3 * max(-10.0, min(10.0, m))))

    scores = {f: margin(w) for f, w in fit.between.items()}
    family = max(fit.families, key=lambda f: scores.get(f, 0.0))
    least = sure(scores[family]) if scores else 1.0
    duels = {}
    for (a, b), w in fit.within.items():
        duels[a, b] = margin(w)
        duels[b, a] = -duels[a, b]
    mine = fit.languages[family]
    ranked = max(mine, key=lambda a: (sum(duels[a, b] > 0 or duels[a, b] == 0 and a < b for b in mine if a != b), sum(duels[a, b] for b in mine if a != b), a))
    return ranked, min([least, *(sure(duels[ranked, b]) for b in mine if b != ranked)])


def test_equals_plain_python(table, documents):
    fit = L.fitted(table, L.remainder() != 0)
    texts = [r["text"] for r in table.limit(60).collect()] + ["The THE der Sch", "ñandú ção", "x", "12 é", "--", None, "\u0434\u0430 \u043d\u0435\u0442"]
    found = {r["doc_id"]: r for r in L.predicted(documents(texts), fit).collect()}
    for k, text in enumerate(texts):
        lang, score = brute_prediction(fit, text)
        assert found[k]["lang_pred"] == lang and found[k]["score"] == pytest.approx(score, abs=1e-4)


def test_odd_rows(table, documents, rows, clashing):
    fit = L.fitted(table, L.remainder() != 0)
    texts = [None, "", "123 -- 45", "the " * 100_000, "the", "the", "é"]
    found = L.predicted(clashing(documents(texts, ids=[None, 1, 2, 3, 4, 4, 5], langs=[None] * 7)), fit)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert found.count() == 7 and out[None] == out[1] == out[2] == ("und", 0.0) and out[3][0] == out[4][0] == "en" and out[5][0] == "fr"


def test_nothing_to_learn_from(documents, rows):
    docs = documents(["some text"], langs=[None])
    assert rows(L.predicted(docs, L.fitted(docs, F.lit(True)))) == [(0, "und", 0.0)]
    empty = documents([])
    assert rows(L.predicted(empty, L.fitted(empty, F.lit(True)))) == []
    one = documents(["the text", "the other"], langs=["en", "en"])
    assert rows(L.predicted(one, L.fitted(one, F.lit(True))), "lang_pred", "score") == [("en", 1.0)] * 2


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 2 * x[:, 1] > 0.3, 1.0, -1.0)
    w = L.machine(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97
