import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallymark.llm import mixing as M
from tallymark.llm import queries


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def corpus(documents, prose):
    sources = ["a"] * 60 + ["b"] * 20 + ["é"] * 10 + [None] * 9 + ["tiny"] + ["void"]
    texts = [prose(5 + 7 * (k % 40), k) for k in range(99)] + ["one two", None]
    return documents(texts, sources=sources), texts, sources


def sizes_of(texts, sources):
    out = {}
    for t, s in zip(texts, sources, strict=True):
        out[s] = out.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return out


@pytest.mark.parametrize("block", [1, 16, 256, 100_000])
def test_takes_the_targets(corpus, block):
    docs, texts, sources = corpus
    sizes = sizes_of(texts, sources)
    target = brute_targets(sizes)
    took = M.mixed(docs, block=block).groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(took) == len(texts)
    for s in sizes:
        rows = [r for r in took if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s] for r in rows)
        assert sum(r["taken"] for r in rows) == int(target[s] + 1e-9)
    assert all(r["taken"] <= 2 * r["size"] for r in took)


def test_order_is_that_of_the_digest(corpus):
    docs, texts, sources = corpus
    took = {r["doc_id"]: r["taken"] for r in M.mixed(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    sizes = sizes_of(texts, sources)
    target = brute_targets(sizes)
    for s in sizes:
        ids = sorted((k for k in range(len(texts)) if sources[k] == s), key=lambda k: hashlib.md5(f"0:{k}".encode()).hexdigest())
        at = 0
        for k in ids:
            n = len((texts[k] or "").split())
            assert took[k] == sum(max(0, min(at + n + e * sizes[s], int(target[s] + 1e-9)) - at - e * sizes[s]) for e in (0, 1))
            at += n


def test_schedule_is_spread_evenly(spark):
    sources = spark.createDataFrame([("a", 40_000, 60_000.0), ("b", 90_000, 30_000.0), ("c", 1_000, 10.0)], "source string, source_size long, target double")
    slots = M.schedule(sources, 100).orderBy("position").collect()
    a = [r["source"] == "a" for r in slots]
    assert sum(r["words"] for r in slots) == 90_010 and len({r["position"] for r in slots}) == len(slots)
    for n in range(100, len(slots), 50):
        assert abs(sum(a[:n]) / n - 600 / 901) < 0.05
    for s in "abc":
        assert [r["rank"] for r in slots if r["source"] == s] == list(range(sum(r["source"] == s for r in slots)))
        # a block comes again only after all others
        assert all(r["rank"] == r["epoch"] * {"a": 400, "b": 900, "c": 10}[s] + r["block"] for r in slots if r["source"] == s)


def brute_positions(texts, sources, block):
    """Blocks of each document in the mix, by counting slots one after the other."""
    sizes = sizes_of(texts, sources)
    target = {s: int(t + 1e-9) for s, t in brute_targets(sizes).items()}
    slots = []  # of all sources, one source after the other: source, block, words
    for s in sorted(sizes, key=lambda x: (x is None, x or "")):
        left, n = target[s], 0
        while left > 0:
            words = min(block, sizes[s] - n * block, left)
            slots.append((s, n, words))
            left, n = left - words, n + 1 if (n + 1) * block < sizes[s] else 0
    bits = max(1, (max(2, len(slots)) - 1).bit_length())
    points = sorted(int(f"{j:0{bits}b}"[::-1], 2) for j in range(len(slots)))
    of = {int(f"{j:0{bits}b}"[::-1], 2): slots[j][0] for j in range(len(slots))}
    queue = {s: [x for x in slots if x[0] == s] for s in sizes}
    at = {p: queue[of[p]].pop(0) for p in points}
    out = {}
    for s in sizes:
        start = 0
        for k in sorted((k for k in range(len(texts)) if sources[k] == s), key=lambda k: hashlib.md5(f"0:{k}".encode()).hexdigest()):
            n = len((texts[k] or "").split())
            out[k] = [p for p, (x, b, words) in at.items() if x == s and max(start, b * block) < min(start + n, b * block + words)]
            start += n
    return out


@pytest.mark.parametrize("block", [16, 256])
def test_documents_stand_where_the_points_put_their_blocks(corpus, block):
    docs, texts, sources = corpus
    took = M.mixed(docs, block=block).groupBy("doc_id").agg(F.sum("slots").alias("n"), F.min("first_position").alias("a"), F.max("last_position").alias("b")).collect()
    expected = brute_positions(texts, sources, block)
    assert {r["doc_id"]: (r["n"], r["a"], r["b"]) for r in took} == {
        k: (len(p), min(p, default=None), max(p, default=None)) for k, p in expected.items()
    }


def test_odd_tables(documents, rows, clashing):
    assert rows(M.mixed(documents([]))) == []
    twice = M.mixed(clashing(documents(["w w w", "w w w", None, ""], ids=[1, 1, None, 2], sources=["s"] * 4)))
    assert twice.groupBy().agg(F.sum("taken")).first()[0] == 9 and twice.filter("doc_id is null and taken = 0").count() == 1
    nothing = M.mixed(documents([None, ""], sources=["a", None]))
    assert rows(nothing, "size", "source_size", "target", "taken") == [(0, 0, 0.0, 0)] * 2


def test_reruns_agree_and_no_python(corpus, rows):
    docs = corpus[0]
    assert rows(M.mixed(docs)) == rows(M.mixed(docs.repartition(5)))
    assert not re.search("Python|Arrow|Pandas", M.mixed(docs)._jdf.queryExecution().executedPlan().toString())


def test_repeated_rows_without_words_stay_apart(spark, documents, tmp_path):
    texts = [None, None, "", "", " ", "w", "w"]
    docs = documents(texts, ids=[None, None, 3, 3, 3, 4, 4], sources=[None] * 2 + ["s"] * 5)
    assert M.mixed(docs).select("row").distinct().count() == len(texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op9_mixing(spark, str(tmp_path)).count() == len(texts)
