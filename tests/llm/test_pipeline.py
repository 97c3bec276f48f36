"""The pipeline against the same steps in plain Python."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from tallymark.llm import language
from tests.llm.test_lsh_forest import brute as near_brute
from tests.llm.test_mixing import brute_targets

pytest.importorskip("public_tokenizers")
SOUNDS = {"en": "the ing tion wh ould", "de": "der sch ung ein äu", "fr": "eau ent qui ois é", "es": "ción los que ñ ado"}


def corpus(documents):
    rng = random.Random(8)
    texts, langs = [], []
    for _ in range(70):
        lang = rng.choice(list(SOUNDS))
        words = ["".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([20, 60, 150]))]
        for kind in [0] + [rng.choice([1, 2, 3]) for _ in range(rng.choice([0, 0, 2]))]:
            new = list(words)
            if kind == 2:
                new[rng.randrange(len(new))] = "edited"
            texts.append(("\n" if kind == 1 else " ").join(new) if kind != 3 else " ".join(new) + " ")
            langs.append(lang)
    texts += ["", None, "1234 !!", "12 34"]
    langs += ["en", "en", None, "de"]
    sources = [rng.choice(["a", "b", "c", None]) for _ in texts]
    return documents(texts, langs=langs, sources=sources), texts, sources


def test_stages_equal_plain_python(spark, documents, tmp_path):
    docs, texts, sources = corpus(documents)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))

    kept = [k for k, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)]
    groups = {}
    for k in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[k]), []).append(k)
    kept = sorted(min(g, key=lambda k: (-len(texts[k]), k)) for g in groups.values())
    kept = [kept[a] for a, b, *_ in near_brute([texts[k] for k in kept]) if a == b]
    sizes = Counter()
    for k in kept:
        sizes[sources[k]] += len(texts[k].split())
    target = brute_targets(sizes)
    expected = []
    for s in sizes:
        at = 0
        for k in sorted((k for k in kept if sources[k] == s), key=lambda k: hashlib.md5(f"0:{k}".encode()).hexdigest()):
            words = texts[k].split()
            for e in (0, 1):
                n = min(len(words), int(target[s] + 1e-9) - at - e * sizes[s])
                if n > 0:
                    text = texts[k] if n == len(words) else " ".join(words[:n])
                    expected.append((k, hashlib.sha256(text.encode()).hexdigest()))
            at += len(words)
    assert sorted((r["doc_id"], r["text_sha256"]) for r in out.collect()) == sorted(expected)
    assert out.filter("not same").count() == 0


def test_each_stage_keeps_the_columns(spark, documents, clashing):
    docs = clashing(corpus(documents)[0]).selectExpr("*", "1 as score", "'x' as lang_pred", "2 as kept_id", "3 as `a.b`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, "").dtypes) == sorted(docs.dtypes), name
        assert stage(spark, documents([]), "").count() == 0, name
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][2] == "near_dedup"


def test_repeated_rows_and_null_ids(spark, documents, prose, tmp_path):
    """Each stage keeps, drops and cuts rows, not ids: with rows in memory and rows in files."""
    a, b, c, d = (prose(n, n) for n in (40, 50, 60, 70))
    near = " ".join(d.split()[:-1] + ["edited"])
    texts, ids = [a, a, a, b, b + " ", c, d, near], [1, 1, None, None, None, None, None, None]
    mem = documents(texts, ids=ids)
    mem.repartition(3).write.parquet(f"{tmp_path}/rows")
    for docs in (mem, spark.read.parquet(f"{tmp_path}/rows")):
        exact = corpus_pipeline.exact_copies(spark, docs, "")
        assert sorted((str(r["doc_id"]), r["text"]) for r in exact.collect()) == sorted([("1", a), ("None", b + " "), ("None", c), ("None", d), ("None", near)])
        left = corpus_pipeline.near_copies(spark, docs, "").collect()
        assert len(left) == 4 and sum(r["text"] in (d, near) for r in left) == 1 and sum(r["text"] == a for r in left) == 1

    sources = ["s"] * 8 + ["t"] * 8
    docs = documents(texts * 2, ids=ids * 2, sources=sources)
    out = corpus_pipeline.mix(spark, docs, "").collect()
    size = sum(len(t.split()) for t in texts)
    target = brute_targets({"s": size, "t": size})
    whole = {s: Counter(t for t in texts) for s in "st"}
    for s in "st":
        mine = [r["text"] for r in out if r["source"] == s]
        assert sum(len(t.split()) for t in mine) == int(target[s] + 1e-9)
        assert all(n <= 2 * whole[s][t] for t, n in Counter(mine).items() if t in whole[s])
        assert sum(t not in whole[s] for t in mine) <= 2


def test_mix_is_written_in_the_order_of_the_schedule(spark, documents, prose, monkeypatch):
    """Each stretch of the written mix has the shares of the whole; sources laid one after the other would not."""
    monkeypatch.setattr(corpus_pipeline, "STRETCH", 16)
    sources = ["a"] * 300 + ["b"] * 300 + ["c"] * 300
    docs = documents([prose(100, k) for k in range(900)], sources=sources)
    out = [(r["source"], len(r["text"].split())) for r in corpus_pipeline.mix(spark, docs, "").collect()]
    words = sum(n for _, n in out)
    shares = {s: sum(n for x, n in out if x == s) / words for s in "abc"}
    for k in range(0, len(out) - 150, 50):
        part = out[k : k + 150]
        for s in "abc":
            assert abs(sum(n for x, n in part if x == s) / sum(n for _, n in part) - shares[s]) < 0.08


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lettered = docs.filter(r"text rlike '\\p{L}'").count()
    assert corpus_pipeline.known_language(spark, docs, folder).count() == lettered
    fit = language.fitted(docs, language.remainder() != 0)
    assert language.predicted(docs, fit, keep=("lang",)).filter("lang <> lang_pred").count() == 0
