"""Chat formatting by perspective rotation: each participant of a dialogue in turn is the assistant, the others are
named users, and only the assistant's own words are trained on.

A dialogue is rendered as segments, one per turn, with their place in the rendered text; joined by place they are the
text. How long a turn is depends only on whether its speaker is the assistant, so places are running sums per dialogue
and per speaker, and a dialogue of any length is never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import running_sum, whole_text

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
SYSTEM, UNNAMED = "system", "unknown"
#: Turns that a running sum takes at a time.
CHUNK = 1024


def rendered(speaker: Column, text: Column, assistant: bool) -> Column:
    """A turn as the assistant's, or as that of a named user; the system's is its own."""
    user = F.concat(F.lit(f"{START}user name="), speaker, F.lit(NEWLINE))
    head = F.lit(f"{START}assistant{NEWLINE}") if assistant else F.when(speaker == SYSTEM, F.lit(f"{START}{SYSTEM}{NEWLINE}")).otherwise(user)
    return F.concat(head, text, F.lit(END + NEWLINE))


def rotated(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per participant and turn: conv_id, assistant, turn, speaker, segment, start, end, mask_start, mask_end.

    start and end are the segment's place in the rendered dialogue, in code points; mask_start and mask_end that of the
    words to learn, with the end mark, and null for other speakers' turns. Participants are the distinct roles of a
    dialogue but the system, so one with no other role gives no rows. A null role is a participant named unknown, a
    null text is empty, and turns with a null dialogue are one dialogue. Turns go by number, nulls first, equal ones by
    role and text. Only the four named columns are read."""
    df = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(UNNAMED)).alias("speaker"), whole_text(text).alias("text"),
    )
    df = df.withColumn("chunk", F.expr(f"coalesce(turn, -1) div {CHUNK}"))
    other = F.length(rendered(F.col("speaker"), F.col("text"), False))
    own = F.length(rendered(F.col("speaker"), F.col("text"), True))
    order = [F.col("turn").asc_nulls_first(), "speaker", "text"]
    placed = running_sum(df, ["conv_id"], "chunk", order, other, "others")
    # what a turn of the assistant's is longer by; places rise with the order and tell equal turns apart
    return _by_participant(placed, own - other)


def _by_participant(placed: DataFrame, longer: Column) -> DataFrame:
    people = placed.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("assistant")).distinct()
    each = placed.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    mine = F.col("speaker") == F.col("assistant")
    each = running_sum(each, ["conv_id", "assistant"], "chunk", ["others"], F.when(mine, longer).otherwise(0), "longer")
    segment = F.when(mine, rendered(F.col("speaker"), F.col("text"), True)).otherwise(rendered(F.col("speaker"), F.col("text"), False))
    start = F.col("others") + F.col("longer")
    each = each.select("conv_id", "assistant", "turn", "speaker", segment.alias("segment"), start.cast("long").alias("start"), mine.alias("_mine"))
    end = F.col("start") + F.length("segment")
    return each.select(
        "conv_id", "assistant", "turn", "speaker", "segment", "start", end.alias("end"),
        F.when(F.col("_mine"), F.col("start") + len(f"{START}assistant{NEWLINE}")).alias("mask_start"),
        F.when(F.col("_mine"), end - len(NEWLINE)).alias("mask_end"),
    )
