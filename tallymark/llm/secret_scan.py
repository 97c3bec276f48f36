"""Secrets in texts: base patterns, and spans of high entropy found by a sliding window.

Positions come from two built-in calls per pattern: the pieces between matches and the matches, both in order, so a
match starts where the lengths before it end. Entropy is Shannon's over a window that moves along a candidate string,
per character class: counts per character go up for the one that enters and down for the one that leaves, and the
entropy changes by these two terms only. All of it is built-in functions within the row; nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import whole_text

# The base patterns. A run that is too short never hides a longer one of its kind, so the two kinds
# that are measured as a whole have their least length in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, the group that is measured, its least length, what each text with a match has; as kinds are listed.
BASE = (
    ("assign", ASSIGN, 2, 12, r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)
#: Character classes: kind, alphabet, its pattern, window, least bits of entropy in a window.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", "[0-9A-Fa-f]", 20, 3.2),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "[A-Za-z0-9+/]", 24, 4.0),
)
#: Allow-list: candidates that are never reported, namely words (no digit), numbers (no letter) and well-known samples.
ALLOWED = r"^[^0-9]*$|^[^A-Za-z]*$|(?i)example|0123456789|abcdefgh|x{6}"

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
FOUND = "array<struct<start:int,end:int,value:string>>"


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def located(text: Column, pattern: str, group: int, least: int, sign: str) -> Column:
    """Array of (start, end, value) of the matches whose group has the least length, in code points."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else values, F.length)
    steps = F.arrays_zip(gaps.alias("gap"), values.alias("value"), held.alias("held"))
    begin = F.struct(F.lit(0).alias("at"), none(FOUND).alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        kept = F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))))
        # the piece after the last match has no match
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["held"] >= least, kept).otherwise(state["found"]).alias("found"))

    # most texts have none: one look is all they get
    return F.when(text.rlike(sign), F.aggregate(steps, begin, step, lambda s: s["found"])).otherwise(none(FOUND))


def entropic(candidate: Column, alphabet: str, window: int, bits: float) -> Column:
    """Array of (start, end), in characters of the candidate, of the windows with enough entropy, joined where they touch."""
    kind = "array<struct<start:int,end:int>>"
    codes = F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(alphabet), c))
    # entropy is log2(window) - total / window, where total sums c log2 c over the counts in the window
    table = F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)))
    limit = (math.log2(window) - bits) * window + 1e-9
    begin = F.struct(
        codes.alias("codes"), F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("total"),
        F.lit(-1).alias("start"), F.lit(-1).alias("end"), none(kind).alias("spans"),
    )

    def step(s: Column, i: Column) -> Column:
        enters, leaves = F.get(s["codes"], i), F.when(i >= window, F.get(s["codes"], i - window)).otherwise(-1)
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
        more = F.get(s["counts"], enters)
        less = F.get(s["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        total = s["total"] + F.get(table, more + 1) - F.get(table, more)
        total = total + F.when(leaves >= 0, F.get(table, less - 1) - F.get(table, less)).otherwise(0.0)
        return F.struct(
            s["codes"].alias("codes"), counts.alias("counts"), total.alias("total"),
            s["start"].alias("start"), s["end"].alias("end"), s["spans"].alias("spans"),
        )

    def mark(s: Column, i: Column) -> Column:
        """Open, extend or close the current span for the window that ends at i."""
        high = (i >= window - 1) & (s["total"] <= limit)
        apart = high & (i - window + 1 > s["end"])
        closed = F.when(apart & (s["end"] >= 0), F.concat(s["spans"], span(s))).otherwise(s["spans"])
        return F.struct(
            s["codes"].alias("codes"), s["counts"].alias("counts"), s["total"].alias("total"),
            F.when(apart, i - window + 1).otherwise(s["start"]).alias("start"), F.when(high, i + 1).otherwise(s["end"]).alias("end"), closed.alias("spans"),
        )

    def span(s: Column) -> Column:
        return F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))

    # a transform over one element binds the state between the two halves, else it would be worked out at each use
    def both(s: Column, i: Column) -> Column:
        return F.get(F.transform(F.array(step(s, i)), lambda t: mark(t, i)), F.lit(0))

    places = F.sequence(F.lit(0), F.length(candidate) - 1)
    return F.aggregate(places, begin, both, lambda s: F.when(s["end"] >= 0, F.concat(s["spans"], span(s))).otherwise(s["spans"]))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and added, arrays of (start, rank, end, kind) sorted by start and kind.

    Positions are code points, the end exclusive. Base spans are those of the patterns, leftmost and not overlapping
    per kind. Added ones are runs of a class's characters where a window has enough entropy; they are left out where
    the allow-list has the run, or a base or earlier span has them whole. A null text counts as empty and has none. Only
    the two named columns are read."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    base = [_matches(F.col("text"), rank, *parts) for rank, parts in enumerate(BASE)]
    added = [_windows(F.col("text"), rank, *parts) for rank, parts in enumerate(CLASSES, len(BASE))]
    found = whole.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), *(a.alias(f"added_{n}") for n, a in enumerate(added)))
    known, kept = F.col("base"), []
    for n in range(len(added)):
        new = _uncovered(F.col(f"added_{n}"), known)
        kept.append(new)
        known = F.concat(known, new)
    return found.select("doc_id", "base", F.array_sort(F.concat(*kept)).alias("added"))


def _matches(text: Column, rank: int, kind: str, pattern: str, group: int, least: int, sign: str) -> Column:
    return F.transform(located(text, pattern, group, least, sign), lambda x: spanned(x["start"], x["end"], rank, kind))


def _windows(text: Column, rank: int, kind: str, alphabet: str, pattern: str, window: int, bits: float) -> Column:
    runs = located(text, f"{pattern}{{{window},}}", 0, window, f"{pattern}{{{window}}}")
    runs = F.filter(runs, lambda x: ~x["value"].rlike(ALLOWED))

    def spans(x: Column) -> Column:
        return F.transform(entropic(x["value"], alphabet, window, bits), lambda y: spanned(x["start"] + y["start"], x["start"] + y["end"], rank, kind))

    return F.flatten(F.transform(runs, spans))


def _uncovered(spans: Column, known: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(known, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"])))


def spanned(start: Column, end: Column, rank: int, kind: str) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
