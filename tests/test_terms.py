"""Term tables against a test of every text with every term."""

import random

from tallymark.operators import terms as T


def test_pairs_equal_all_tests(spark, rows):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé 😀") for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["", None, "abc", "abc", "x" * 3000]
    terms = ["".join(rng.choice("abcé 😀") for _ in range(rng.randint(1, 6))) for _ in range(300)] + [None, "ab", "ab", "😀", "nowhere", "x" * 2999, "x" * 3001]
    for extra in ([], [""]):
        found = T.contained_terms(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms + extra], "term string"))
        expected = {(x, y) for x in texts if x is not None for y in terms + extra if y is not None and y in x}
        assert rows(found) == sorted(expected, key=repr)


def test_only_the_rarest_gram_is_looked_up(spark):
    """A term of common grams and a rare one meets only the texts of the rare one."""
    texts = spark.createDataFrame([("the thing",)] * 3 + [(f"the thing {n}",) for n in range(50)] + [("the thing xyz",)], "text string")
    terms = spark.createDataFrame([("thing xyz",)], "term string")
    plan = T.contained_terms(texts, terms)
    assert [tuple(r) for r in plan.collect()] == [("the thing xyz", "thing xyz")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = T.contained_terms(texts, terms)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in shown and "Cartesian" not in shown
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_titles_and_counts(spark, rows):
    df = spark.createDataFrame([(1, "g", "Deaths by age"), (2, "g", "Deaths by age"), (3, "h", "Visits"), (4, None, "Deaths"), (5, "h", None)], "id int, k string, title string")
    terms = spark.createDataFrame([("Deaths",), ("age",), ("age",), ("zzz",)], "term string")
    assert rows(T.titled(df, terms, "title"), "id") == [(1,), (2,), (4,)]
    assert rows(T.titled(df, terms, "title", exact=True), "id") == [(4,)]
    found = rows(T.term_counts(df, ["k"], terms, "title"), "k", "term", "n", "total", "percent")
    assert found == sorted([("g", "Deaths", 2, 2, 100.0), ("g", "age", 2, 2, 100.0), (None, "Deaths", 1, 1, 100.0)], key=repr)
    assert T.contained_terms(df.limit(0), terms, "title").isEmpty() and T.contained_terms(df, terms.limit(0), "title").isEmpty()


def test_a_text_is_not_moved_once_per_term(spark):
    """Texts go by a digest where only their terms are asked for, and the grams of texts meet a few terms without a shuffle."""
    df = spark.createDataFrame([(k, f"alpha beta gamma {k}") for k in range(5)], "k int, text string")
    terms = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "term string")
    for found in (T.term_counts(df, ["k"], terms, "text"), T.titled(df, terms, "text")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(text#" not in plan and "hashpartitioning(gram#" not in plan
    assert {(r["k"], r["term"], r["n"]) for r in T.term_counts(df, ["k"], terms, "text").collect()} == {(k, t, 1) for k in range(5) for t in ("alpha", "beta", "gamma")}
