import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import exact_dedup


def brute(rows):
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    out = []
    for i, t in rows:
        group = [(j, u or "") for j, u in rows if bare[j] == bare[i]]
        keep = min(group, key=lambda x: (-len(x[1]), x[0]))[0]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(bare[i].encode()).hexdigest()))
    return sorted(out)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("capacity", [1, 4, 1 << 16])
def test_equals_brute_force(documents, rows, clashing, capacity):
    texts = ["a b", "ab", "a\tb ", None, "", " \n", "é b", "éb", "x" * 300_000, "x " * 300_000, "A b", "a b"] + ["hot text"] * 60
    texts += [f"text {k // 2}" for k in range(80)]
    found = exact_dedup.duplicates(clashing(documents(texts)), capacity=capacity)
    assert rows(found, *COLUMNS) == sorted(brute(list(enumerate(texts))), key=repr)


def test_buckets_split_until_their_keys_fit(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) key")
    table = exact_dedup.directory(keys, 100)
    bits = table.first()["bits"]
    held = keys.withColumn("cell", exact_dedup.cell_of(bits)).join(table, "cell").groupBy("bucket").count().collect()
    assert len(held) > 50 and max(r["count"] for r in held) <= 100
    # a bucket is a range of cells
    cells = sorted((r["cell"], r["bucket"]) for r in table.collect())
    assert [b for _, b in cells] == sorted(b for _, b in cells)


def test_colliding_keys_are_told_apart_by_bytes():
    batch = pa.RecordBatch.from_pydict({"entry": [1, 2, 3, 4], "bucket": [0] * 4, "key": [7] * 4, "bare": ["a", "b", "a", "c"]})
    (out,) = exact_dedup.chained([batch])
    assert out.column("slot").to_pylist() == [0, 1, 0, 2] and out.column("entry").to_pylist() == [1, 2, 3, 4]


@pytest.mark.parametrize("capacity", [1, 1 << 16])
def test_different_texts_under_one_key(documents, rows, capacity):
    texts = ["a", "b", "a ", "c", "b", None, "", "d"] + ["hot text"] * 40 + [f"text {k // 3}" for k in range(60)]
    for keys in (1, 3):
        found = exact_dedup.duplicates(documents(texts).repartition(5), capacity=capacity, hashed=lambda bare, n=keys: F.pmod(F.xxhash64(bare), F.lit(n)))
        assert rows(found, *COLUMNS) == sorted(brute(list(enumerate(texts))), key=repr)
        assert found.filter("group_size > 1").select("slot").distinct().count() > 1


def test_groups_form_by_bytes_and_not_by_digest(documents, monkeypatch):
    # a digest that is equal for all texts changes the digests only
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *_: F.lit("0"))
    found = exact_dedup.duplicates(documents(["a", "b", "a", "b", "b"]), hashed=lambda bare: F.length(bare).cast("long"))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found.collect()} == {(0, 0, 2), (2, 0, 2), (1, 1, 3), (3, 1, 3), (4, 1, 3)}


def test_forgotten_texts_join_their_group_again(documents, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REMEMBERED", 3)
    texts = [f"text {k % 4}" for k in range(40)]
    assert rows(exact_dedup.duplicates(documents(texts)), *COLUMNS) == sorted(brute(list(enumerate(texts))), key=repr)


def test_ids_of_any_type(spark):
    least = -(1 << 63)
    long = exact_dedup.duplicates(spark.createDataFrame([(5, "t"), (least, "t"), (None, "t")], "doc_id long, text string"))
    assert {r["keep_id"] for r in long.collect()} == {least}
    text = exact_dedup.duplicates(spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "longer"), (None, "u")], "doc_id string, text string"))
    assert sorted((r["doc_id"] or "", r["keep_id"] or "", r["kept"]) for r in text.collect()) == [("", "", True), ("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_repeated_rows_null_ids_and_no_rows(documents, rows):
    found = exact_dedup.duplicates(documents(["t", "t", "t", "u"], ids=[4, 4, None, 9]))
    assert [r[:4] for r in rows(found, *COLUMNS)] == sorted([(4, 4, 3, True), (4, 4, 3, True), (None, 4, 3, False), (9, 9, 1, True)], key=repr)
    assert rows(exact_dedup.duplicates(documents([])), *COLUMNS) == []
