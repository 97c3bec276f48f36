"""Text cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

NBSP = "\u00a0"

# Header words whose inner capitals do not start a new column.
JOINED_HEADER_WORDS = ("Opioid(Unknown)", "FuranylFentanyl", "FuranylUF-17")

# Report spellings and the labels published for them.
DRUG_LABELS = {
    "FuranylFentanyl": "Furanyl Fentanyl",
    "FuranylUF-17": "Furanyl UF-17",
    "Opioid(Unknown)": "Opioid (Unknown)",
}


def no_nbsp(c: Column) -> Column:
    """Drop non-breaking spaces, which trim() leaves alone."""
    return F.replace(c, F.lit(NBSP), F.lit(""))


def clean_label(c: Column) -> Column:
    return F.trim(no_nbsp(c))


def squeeze_blanks(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), " {2,}", " ")


def no_blanks(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def lookup_key(c: Column) -> Column:
    """Key for title lookups: text before the first comma, lower case, no blanks."""
    return F.lower(no_blanks(F.split_part(c, F.lit(","), F.lit(1))))


def lookup_term(term: str) -> str:
    """Driver-side twin of :func:`lookup_key` for the terms a caller passes in."""
    return term.split(",")[0].lower().replace(" ", "")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    return reduce(or_, [c.contains(t) for t in terms], F.lit(False))


def title_case(c: Column) -> Column:
    """Capital at the first word character after each blank, the rest lower case."""
    pattern = r"^(\W*)(\w?)([\s\S]*)$"

    def word(w: Column) -> Column:
        return F.concat(
            F.regexp_extract(w, pattern, 1),
            F.upper(F.regexp_extract(w, pattern, 2)),
            F.lower(F.regexp_extract(w, pattern, 3)),
        )

    return F.array_join(F.transform(F.split(c, r"(?<=\s)(?=\S)"), word), "")


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def fill_template(template: Column, token: str, value: Column) -> Column:
    return F.replace(template, F.lit(token), value)


def relabel(c: Column, labels: Mapping[str, str]) -> Column:
    """Replace whole values by a small fixed mapping; other values pass through."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def capital_tokens(c: Column, whole: Sequence[str] = JOINED_HEADER_WORDS) -> Column:
    """Split joined header words at capitals, keeping the words in ``whole`` together."""
    kept = [w.replace("(", r"\(").replace(")", r"\)") for w in whole]
    pattern = "(" + "|".join([*kept, r"[A-Z][a-z0-9\-\(\)\*]*"]) + ")"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def label_part(line: Column) -> Column:
    """Label in front of the first digit or dash, without blanks."""
    return no_blanks(F.regexp_extract(line, r"^([^0-9-]*)", 1))


def value_parts(line: Column) -> Column:
    """Blank-separated values from the first digit or dash onward."""
    tail = F.regexp_extract(line, r"^[^0-9-]*(.*)$", 1)
    return F.split(squeeze_blanks(tail), " ")
