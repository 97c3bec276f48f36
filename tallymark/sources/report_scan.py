"""Report rules over rows of lines, for reports too long for one row.

The rules are one machine that reads lines: it is outside of a table, inside, or inside behind a broken line, and carries
what was printed above (title, years, manner, sex, year, heads, the first part of a broken line). A report is cut into
blocks of lines. What a block does to the machine depends only on the state that it is entered in, so each block is run
once from each state, with what is carried left open; these transitions compose associatively, chunk by chunk, into the
state that each block is entered with, and each block is read once more from there. No task holds more than a block.

:mod:`tallymark.sources.reports` says the same by splits of a text and is faster while a report fits in one row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions.text import capital_tokens, label_part, no_blanks, squeeze_blanks, value_parts
from tallymark.sources.reports import FOOTNOTES, MANNERS, PROSE_WORDS, lookup_title

BLOCK_LINES, CHUNK_BLOCKS = 65_536, 1024
OUTSIDE, INSIDE, BROKEN = "outside", "inside", "broken"
BLANK, DROPPED, YEARS, HEAD, DATA = range(5)
#: How a value joins what is carried: the last one counts, the first one, or all one after another.
CARRIED = {"title": "last", "table_no": "last", "manner": "last", "sex": "last", "year": "last", "years": "first", "head": "all", "part": "all"}
FOUND = "line_no long, title string, table_no long, years string, head string, manner string, sex string, year string, line string"


@dataclass
class Carried:
    """Values with what they join: a fresh one stands for itself, another one joins that of the block before."""

    fresh: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(CARRIED, False))
    value: dict[str, str | None] = field(default_factory=lambda: dict.fromkeys(CARRIED))

    def put(self, name: str, value) -> None:
        self.value[name] = joined(name, self.value[name], value)

    def clear(self, *names: str) -> None:
        for name in names:
            self.fresh[name], self.value[name] = True, None

    def then(self, later: Carried) -> Carried:
        both = Carried(dict(self.fresh), dict(self.value))
        for name in CARRIED:
            if later.fresh[name]:
                both.fresh[name], both.value[name] = True, later.value[name]
            else:
                both.put(name, later.value[name])
        return both


def joined(name: str, before, after):
    if before is None or after is None:
        return after if before is None else before
    return {"last": after, "first": before, "all": f"{before} {after}"}[CARRIED[name]]


def step(state: str, kind: int, row: dict, carried: Carried) -> tuple[str, str | None]:
    """Read one line; gives the new state and, where the line ends one, the line of data."""
    if state == OUTSIDE:
        if not row["title"]:
            return OUTSIDE, None
        carried.clear(*CARRIED)
        carried.put("title", row["title"])
        carried.put("table_no", row["line_no"])
        return INSIDE, None
    if kind == BLANK:
        return OUTSIDE, None
    if kind == DROPPED:
        return state, None
    if kind == YEARS:
        carried.put("years", row["line"])
        return state, None
    line = row["line"]
    if state == INSIDE:
        if kind == HEAD:
            carried.put("head", line)
            return INSIDE, None
        if row["year"]:
            carried.put("year", row["year"])
        if row["manner"]:
            carried.put("manner", row["manner"])
        if row["sex"]:
            carried.put("sex", row["sex"])
        line = row["rest"]
        if not line:
            return INSIDE, None
    carried.put("part", line)
    return (BROKEN, None) if row["open"] else (INSIDE, line)


def run(rows: Sequence[dict], state: str, carried: Carried, found: Callable[[dict], None] | None = None) -> str:
    for row in rows:
        state, line = step(state, row["kind"], row, carried)
        if line is not None:
            if found:
                found({**{c: carried.value[c] for c in CARRIED}, "line_no": row["line_no"], "line": carried.value["part"]})
            carried.clear("part")
        elif state != BROKEN:
            carried.clear("part")
    return state


def transition(rows: Sequence[dict]) -> dict[str, tuple[str, Carried]]:
    """What a block does, from each state that it can be entered in."""
    out = {}
    for state in (OUTSIDE, INSIDE, BROKEN):
        carried = Carried()
        out[state] = (run(rows, state, carried), carried)
    return out


def composed(first: Mapping, second: Mapping) -> dict:
    """The transition of two blocks, one after the other; composing is associative."""
    return {entry: (second[left][0], carried.then(second[left][1])) for entry, (left, carried) in first.items()}


def dumped(state: str, carried: Carried) -> list:
    return [state, carried.fresh, carried.value]


def loaded(item: list) -> tuple[str, Carried]:
    return item[0], Carried(item[1], item[2])


def _groups(parts: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of rows that come sorted by their keys."""
    current, rows = None, []
    for part in parts:
        for row in part.to_dict("records"):
            key = tuple(row[k] for k in keys)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows


def _by_group(df: DataFrame, keys: Sequence[str], order: str, read: Callable, schema: str) -> DataFrame:
    """One call of ``read`` per group, for rows dealt by group and sorted."""
    def groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for key, rows in _groups(parts, keys):
            yield pd.DataFrame(list(read(key, rows)), columns=names).astype(object)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(groups, schema)


def classified(
    lines: DataFrame, titles: Mapping[str, str], open_end: str = "&$", dropped: str = r"^\d|^Race", heads: bool = False, block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Lines ``(report, line_no, line)`` with what the machine asks of them; a NULL line is blank.

    ``open_end`` marks a line that goes on in the next one, ``dropped`` lines that are no data. With ``heads``, lines
    without a manner head the table, and a year stands in front of the first manner of its lines."""
    lines = lines.withColumn("line", F.coalesce("line", F.lit("")))
    prose = "|".join(" *".join(w) for w in PROSE_WORDS)
    key, manners = F.lower(no_blanks(F.col("line"))), "|".join(MANNERS)
    title = F.lit(None).cast("string")
    for name in reversed(list(titles)):
        title = F.when(key.contains(lookup_title(name)) & ~F.col("line").rlike(f"(?i)(?:{prose})"), F.lit(name)).otherwise(title)
    text = squeeze_blanks(F.col("line"))
    year = F.regexp_extract(text, r"^(\d{4}) ", 1) if heads else F.lit("")
    bare = F.when(F.col("year") == "", F.col("text")).otherwise(F.expr("substring(text, 6)"))
    manner = F.regexp_extract("bare", rf"^({manners})", 1)
    behind = F.when(F.col("manner") == "", F.col("bare")).otherwise(F.regexp_replace("bare", r"^\S+ ?", ""))
    sex = F.lit("") if heads else F.regexp_extract("behind", r"^(Male|Female)", 1)
    rest = F.when(F.col("sex") == "", F.when((F.col("manner") == "") | F.lit(heads), F.col("behind")).otherwise("")).otherwise("")
    kind = (
        F.when(F.col("line").rlike(r"^ {0,3}$"), BLANK).when((text == "") | text.rlike("|".join(FOOTNOTES)), DROPPED)
        .when(text.rlike(r"^\d{4}(?: \d{4})*$"), YEARS).when(F.lit(heads) & ~text.rlike(manners), HEAD)
        .when(text.rlike(dropped) if not heads else F.lit(False), DROPPED).otherwise(DATA)
    )
    # a title line is data inside of a table, so its text and its title both stay
    named = lines.select("report", F.col("line_no").cast("long").alias("line_no"), title.alias("title"), kind.alias("kind"), "line", text.alias("text"), year.alias("year"))
    named = named.withColumn("bare", bare).withColumn("manner", manner).withColumn("behind", behind).withColumn("sex", sex)
    return named.select(
        "report", F.expr(f"line_no div {block_lines}").alias("block"), "line_no", "kind", F.coalesce("title", F.lit("")).alias("title"),
        F.col("text").alias("line"), "year", "manner", "sex", rest.alias("rest"), F.col("text").rlike(open_end).alias("open"),
    )


def scanned(rows: DataFrame, chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """The lines of data of classified rows, with all that is carried down to them."""
    kind = rows.schema["report"].dataType.simpleString()

    def summary(key: tuple, block: list[dict]):
        yield (*key, json.dumps({s: dumped(*t) for s, t in transition(block).items()}))

    blocks = _by_group(rows, ["report", "block"], "line_no", summary, f"report {kind}, block long, moves string")
    blocks = blocks.withColumn("chunk", F.expr(f"block div {chunk_blocks}"))

    def together(key: tuple, parts: list[dict]):
        moves = None
        for part in parts:
            one = {s: loaded(t) for s, t in json.loads(part["moves"]).items()}
            moves = one if moves is None else composed(moves, one)
        yield (*key, json.dumps({s: dumped(*t) for s, t in moves.items()}))

    chunks = _by_group(blocks, ["report", "chunk"], "block", together, f"report {kind}, chunk long, moves string")

    def entered(start: str | None, number: str):
        def walk(key: tuple, parts: list[dict]):
            state, carried = loaded(json.loads(parts[0][start])) if start else (OUTSIDE, Carried())
            for part in parts:
                yield key[0], part[number], json.dumps(dumped(state, carried))
                state, later = loaded(json.loads(part["moves"])[state])
                carried = carried.then(later)

        return walk

    starts = _by_group(chunks, ["report"], "chunk", entered(None, "chunk"), f"report {kind}, chunk long, start string")
    placed = blocks.join(starts, ["report", "chunk"])
    entries = _by_group(placed, ["report", "chunk"], "block", entered("start", "block"), f"report {kind}, block long, entry string")

    def read(key: tuple, block: list[dict]):
        found: list[dict] = []
        state, carried = loaded(json.loads(block[0]["entry"]))
        run(block, state, carried, found.append)
        for f in found:
            yield (key[0], *(f[c.split()[0]] for c in FOUND.split(", ")))

    return _by_group(rows.join(entries, ["report", "block"]), ["report", "block"], "line_no", read, f"report {kind}, {FOUND}")


def sex_race(lines: DataFrame, titles: Mapping[str, str], **options) -> DataFrame:
    """Race lines below manner and sex lines: ``(report, title, manner, sex, race, year, raw_value)``."""
    found = scanned(classified(lines, titles, **options))
    text = F.replace(F.replace("line", F.lit("non -s"), F.lit("nonS")), F.lit("non-s"), F.lit("nonS"))
    return _years(found.withColumn("line", text).filter("manner is not null and sex is not null"), "race")


def _years(found: DataFrame, label: str) -> DataFrame:
    rows = found.withColumn("_pairs", F.arrays_zip(F.split("years", " ").alias("year"), value_parts(F.col("line")).alias("raw_value")))
    rows = rows.select("report", "title", "table_no", "line_no", "manner", "sex", label_part(F.col("line")).alias(label), F.inline("_pairs"))
    return rows.filter("year is not null and raw_value is not null").withColumn("year", F.col("year").cast("int"))


def manner_breakdown(lines: DataFrame, titles: Mapping[str, str], **options) -> DataFrame:
    """Drug counts per year and manner below heads of joined capitals: ``(report, title, year, manner, drug, raw_value)``."""
    found = scanned(classified(lines, titles, open_end="(?!)", heads=True, **options))
    values: Column = F.arrays_zip(capital_tokens(F.col("head")).alias("drug"), F.split("line", " ").alias("raw_value"))
    rows = found.filter("head is not null").select("report", "title", "table_no", "line_no", F.col("year").cast("int").alias("year"), "manner", F.inline(values))
    return rows.filter("drug is not null and raw_value is not null")
