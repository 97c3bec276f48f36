import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as documents; only text is asked for."""

    def frame(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        ids, langs, sources = ids or list(range(n)), langs or ["en"] * n, sources or ["s"] * n
        rows = [(i, t, a, s, None if t is None else len(t)) for i, t, a, s in zip(ids, texts, langs, sources, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return frame


@pytest.fixture(scope="session")
def clashing():
    """Further columns under names that operators use inside."""
    names = "key bare size cell bucket bits slot part place rep found start end low high block epoch taken chunk _value _id _text target digest shingles".split()

    def add(df):
        return df.select("*", *(F.lit("x").alias(n) for n in names if n not in df.columns))

    return add


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    syllables = "ba ke ti lo mu ra ne so vi da po gu".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return text
