"""Memory of Python workers: small batches, and what is free goes back to the system."""

import pyarrow as pa

import corpus_pipeline
from tallymark.llm import shared


def test_batches_are_small_unless_the_session_says_otherwise(spark, documents):
    session = spark.newSession()
    docs = documents(["some words " * 1000] * 3000).repartition(1)
    docs.createOrReplaceGlobalTempView("long_texts")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    def largest():
        return max(r["bytes"] for r in session.table("global_temp.long_texts").mapInArrow(sizes, "bytes long").collect())

    assert largest() > 16 << 20
    corpus_pipeline.known_language(session, session.table("global_temp.long_texts").limit(3), "")
    assert largest() < 6 << 20
    session.conf.set(shared.BATCH_SETTING, str(8 << 20))
    shared.small_batches(session)
    assert 6 << 20 < largest() < 10 << 20


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
    work = shared.tidied(lambda batches: (b + 1 for b in batches))
    found = work(iter([1, 2]))
    assert next(found) == 2 and not given
    assert list(found) == [3] and given == [1]
    found = work(iter([1, 2]))
    next(found)
    found.close()  # a task that does not read to the end
    assert given == [1, 1]


def test_give_back_runs():
    shared.give_back()
