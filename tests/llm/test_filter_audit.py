import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallymark.llm import filter_audit as A


def brute_mask(texts, ids):
    out = []
    for text, i in zip(texts, ids, strict=True):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [k for u, k in zip(texts, ids, strict=True) if (u or "") == t and k is not None]
        failed = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and min(same) < i]
        out.append(sum(f << k for k, f in enumerate(failed)))
    return out


def brute_audit(texts, ids, parts, good, toxic):
    fails = [{f for k, f in enumerate("ABCDE") if m >> k & 1} for m in brute_mask(texts, ids)]
    rows, shapley = {}, {}
    for part in {p or "" for p in parts}:
        mine = [k for k, p in enumerate(parts) if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                before = [k for k in mine if f in fails[k] and k not in left]
                left = [k for k in left if f not in fails[k]]
                rows[part, order, step] = (
                    len(left), len(gone), len(before), sum(fails[k] == {f} for k in mine), sum(ids[k] in good for k in gone), sum(ids[k] in toxic for k in gone),
                )
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


def corpus(prose, n=60):
    rng = random.Random(6)
    texts = [prose(rng.choice([3, 150, 250, 400]), k) for k in range(n)]
    texts = [t.title() if rng.random() < 0.2 else t + " 100 %" if rng.random() < 0.2 else " ".join(["same word"] * 150) if rng.random() < 0.1 else t for t in texts]
    texts += [rng.choice(texts) for _ in range(n // 2)] + ["", None, "", " ", "É" * 300, "A" + "b" * 48, "A" + "b" * 49]
    return texts, rng


def test_equals_brute_force(spark, documents, rows, clashing, prose):
    texts, rng = corpus(prose)
    ids = rng.sample(range(1000), len(texts))
    parts = [rng.choice(["x", "y", "", None]) for _ in texts]
    good, toxic = set(rng.sample(ids, 30)), set(rng.sample(ids, 30))
    labels = [(i, int(i in good), int(i in toxic)) for i in ids[::2]] + [(i, None if i not in good else 1, int(i in toxic)) for i in ids[1::2]]
    labels += [(None, 1, 1), (5000, 1, 1)] + labels[:5]  # repeated rows count once
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masks = A.masks(clashing(documents(texts, ids=ids, sources=parts)))
    assert rows(masks, "doc_id", "mask") == sorted(zip(ids, brute_mask(texts, ids), strict=True), key=repr)
    found = A.audit(masks, labels)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == brute_audit(texts, ids, parts, good, toxic)
    assert found.count() == 3 * 600


@pytest.mark.parametrize("sent", [0, 1 << 25])
def test_texts_that_share_a_hash_are_told_apart(documents, rows, prose, monkeypatch, sent):
    """The hash only chooses what is compared; the sketch is sent to all tasks, or rows are dealt by shard."""
    monkeypatch.setattr(A, "SENT_BYTES", sent)
    texts, rng = corpus(prose)
    ids = rng.sample(range(1000), len(texts))
    weak = lambda text: F.length(text).cast("long") % 7
    found = A.masks(documents(texts, ids=ids), text_hash=weak)
    assert rows(found, "doc_id", "mask") == sorted(zip(ids, brute_mask(texts, ids), strict=True), key=repr)


def test_sketch_clears_only_unique_texts(spark, monkeypatch):
    monkeypatch.setattr(A, "COUNTED", 500)
    n = 20_000
    rows = spark.range(n).select(F.xxhash64(F.lit("t"), F.least("id", F.lit(n - 3000))).alias("h"), "id").repartition(5)
    shards = A.shards_of(n)
    assert shards == 4 and A.shards_of(0) == A.shards_of(1) == 1
    sketch = A.sketched(rows.select("h", A.spread(F.col("h")).alias("places")), shards)
    left = A.maybe_repeated(rows, sketch, shards)
    assert left.filter(F.col("id") >= n - 3000).count() == 3000
    assert left.count() < 3000 + 0.08 * n


def test_only_possible_repeats_are_shuffled(documents, prose):
    """The text meets a shuffle only behind the sketch's filter."""
    docs = documents([prose(30, k) for k in range(40)])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    sketch = A.sketched(rows.select("h", A.spread(F.col("h")).alias("places")), 1)
    plan = A.maybe_repeated(rows, sketch, 1).groupBy("h", "text").agg(F.min("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_null_ids_repeated_rows_and_no_rows(spark, documents, rows):
    text = "word " * 10
    ids = [4, 4, None, None, 2, 9]
    texts = [text, text, text, "other", text, None]
    assert rows(A.masks(documents(texts, ids=ids)), "doc_id", "mask") == sorted(zip(ids, brute_mask(texts, ids), strict=True), key=repr)
    assert [m >> 4 for m in brute_mask(texts, ids)] == [1, 1, 0, 0, 0, 0]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(A.audit(A.masks(documents([])), labels)) == []
    assert A.audit(A.masks(documents(["x " * 100_000])), labels).filter("step = 5 and kept = 0").count() == 120
