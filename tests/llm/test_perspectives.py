from tallymark.llm import perspectives as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    out = []
    for conv in {t[0] for t in turns}:
        own = sorted(
            ((t[1], t[2] or "unknown", t[3] or "") for t in turns if t[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
        )
        for who in {s for _, s, _ in own if s != "system"}:
            at = 0
            for turn, speaker, text in own:
                head = "assistant" if speaker == who else "system" if speaker == "system" else f"user name={speaker}"
                segment = f"<|im_start|>{head}\n{text}<|im_end|>\n"
                mask = (at + 22, at + len(segment) - 1) if speaker == who else (None, None)
                out.append((conv, who, turn, speaker, segment, at, at + len(segment), *mask))
                at += len(segment)
    return sorted(out, key=repr)


def test_equals_brute_force(spark, rows, clashing):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi é😀"), (1, 2, "bob", "x" * 50_000), (1, 3, "ann", None), (1, 3, "cy", "tie"), (1, 3, "cy", "tie")]
    turns += [(2, 0, "system", "alone"), (None, None, None, None), (None, 4, "ann", "null dialogue"), (3, None, "bob", "first"), (3, 2, "ann", "")]
    turns += [(4, k, "ab"[k % 2], f"turn {k}") for k in range(3000)]
    found = P.rotated(clashing(spark.createDataFrame(turns, SCHEMA)))
    assert rows(found) == brute(turns)
    # the mask is the assistant's words and the end mark
    marked = [r for r in found.collect() if r["mask_start"] is not None]
    assert all(r["segment"][r["mask_start"] - r["start"] : r["mask_end"] - r["start"]].endswith("<|im_end|>") for r in marked)


def test_no_rows(spark, rows):
    assert rows(P.rotated(spark.createDataFrame([], SCHEMA))) == []
