"""Language identification in two steps: the family first, then the language among its close relatives.

Features are hashed byte n-grams of the whole text. One linear support vector machine per family tells it from the
others; within a family, one per pair of its languages votes. The machines are fitted on a bounded sample of labelled
rows, on the driver; everything else is a pass over the table in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.shared import tidied, whole_text
from tallymark.llm.shingles import pieces, utf8

#: Different labelled texts that the machines are fitted on, over all languages together.
SAMPLE = 2400
FEATURES = 4096
#: Bytes of a text whose n-grams are counted at a time.
SLICE = 1 << 18
UNKNOWN = "und"

# Families of common languages by code. A language without an entry is a family of its own.
FAMILIES = {
    "Germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "Romance": "fr es pt it ro ca gl oc la".split(),
    "Slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "Uralic": "fi et hu".split(),
    "Baltic": "lt lv".split(),
    "Celtic": "ga gd cy br".split(),
    "Turkic": "tr az kk uz".split(),
    "Indo-Aryan": "hi ur bn mr gu pa ne".split(),
    "Semitic": "ar he mt am".split(),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Bytes as the n-grams see them: letters in lower case, other ASCII as a blank, the rest as it is.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def features(data: np.ndarray) -> np.ndarray:
    """Counts of a text's byte n-grams of one to three bytes, damped and of unit length."""
    counts = np.zeros(FEATURES, np.int64)
    size = len(data) + 2
    # a slice at a time, with the two bytes after it that its n-grams reach into
    for start in range(0, size, SLICE):
        part = data[max(0, start - 1) : start + SLICE + 1].astype(np.uint8)
        x = _FOLD[np.concatenate([[32] if not start else [], part, [32] if start + SLICE + 2 >= size else []]).astype(np.uint8)]
        code = x
        for n in range(3):
            if n:
                code = code[:-1] * np.uint32(257) + x[n:]
            hashed = ((code[:SLICE] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(hashed, minlength=FEATURES)
    counts = np.sqrt(counts.astype(np.float32))
    return counts / np.linalg.norm(counts)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last one the bias) of a linear support vector machine, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    alpha, w, norms = np.zeros(len(x)), np.zeros(x.shape[1]), (x**2).sum(1)
    order = np.random.default_rng(len(x))
    # both sides weigh alike, however many rows they have
    costs = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (w @ x[i]) - 1) / norms[i], 0.0), costs[i])
            if alpha[i] != old:
                w += (alpha[i] - old) * y[i] * x[i]
                moved = max(moved, abs(alpha[i] - old))
        if moved < 1e-3:
            break
    return w.astype(np.float32)


@dataclass
class Discriminator:
    """Fitted machines: families (all or one) and pairs of languages within a family."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    between: dict[str, np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNKNOWN, 0.0
        margins = {f: float(w[:-1] @ x + w[-1]) for f, w in self.between.items()}
        family = max(self.families, key=lambda f: margins.get(f, 0.0))
        score = _sure(margins[family]) if margins else 1.0
        languages = self.languages[family]
        votes, sums = dict.fromkeys(languages, 0), dict.fromkeys(languages, 0.0)
        won = {}
        for a, b in combinations(languages, 2):
            w = self.within[a, b]
            margin = float(w[:-1] @ x + w[-1])
            votes[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
            won[a, b], won[b, a] = margin, -margin
        best = max(languages, key=lambda c: (votes[c], sums[c], c))
        return best, min([score, *(_sure(won[best, c]) for c in languages if c != best)])


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-3 * np.clip(margin, -10, 10))))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fitted(docs: DataFrame, learns: Column, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> Discriminator:
    """Fit on the rows that may be learned from, on at most `sample` different texts. Of each language the same number
    is taken, those with the smallest hash of the text, so that repeated rows count once and each language has one at
    least; beyond `sample` languages, those with the most different texts are learned."""
    labelled = docs.filter(learns & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    labelled = labelled.withColumn("place", F.pmod("hash", F.lit(1 << 30)) / (1 << 30))
    texts = F.approx_count_distinct("hash")
    languages = labelled.groupBy("lang").agg(texts.alias("n"), F.min("place").alias("least")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not languages:
        return Discriminator()
    quota = max(1, sample // len(languages))
    # a third more than the quota, as counts and places are those of hashes; the first of each language in any case
    limits = [(r["lang"], max(r["least"], 1.3 * (quota + 3) / max(1, r["n"]))) for r in languages]
    limits = docs.sparkSession.createDataFrame(limits, "of string, most double")
    # at most `sample` rows
    rows = labelled.join(F.broadcast(limits), (F.col("lang") == F.col("of")) & (F.col("place") <= F.col("most"))).select("lang", "hash", "place", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, int]] = set()  # about as many as the sample has rows
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist(), strict=True))
            first = []
            for i, key in enumerate(keys):
                if key not in met:
                    met.add(key)
                    first.append(i)
            found = [features(data[offsets[i] : offsets[i + 1]]).astype(np.float16).tobytes() for i in first]
            taken = pa.array(first, pa.int64())
            names = ["lang", "hash", "place"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in names), pa.array(found, pa.binary())], names=[*names, "features"])

    once = rows.mapInArrow(tidied(count), "lang string, hash long, place double, features binary").groupBy("lang", "hash", "place").agg(F.any_value("features").alias("features"))
    nearest = F.row_number().over(Window.partitionBy("lang").orderBy("place", "hash"))
    by_lang: dict[str, list] = {}
    for r in once.withColumn("n", nearest).filter(F.col("n") <= quota).collect():
        by_lang.setdefault(r["lang"], []).append((r["n"], bytes(r["features"])))
    vectors = {c: np.stack([np.frombuffer(f, np.float16) for _, f in sorted(v)]).astype(np.float32) for c, v in sorted(by_lang.items())}
    out = Discriminator()
    for code in vectors:
        out.languages.setdefault(FAMILY.get(code, code), []).append(code)
    out.families = sorted(out.languages)
    if len(out.families) > 1:
        for family in out.families:
            out.between[family] = _against([vectors[c] for c in out.languages[family]], [vectors[c] for c in vectors if c not in out.languages[family]])
    for codes in out.languages.values():
        for a, b in combinations(codes, 2):
            out.within[a, b] = _against([vectors[a]], [vectors[b]])
    return out


def _against(ours: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate([*ours, *others])
    y = np.where(np.arange(len(x)) < sum(map(len, ours)), 1.0, -1.0)
    return machine(x, y)


def predicted(docs: DataFrame, fit: Discriminator, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1), and the columns in keep.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing could be learned. The
    whole text is read. Repeated rows are predicted alike."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(read))
            lettered = batch.column("_lettered").to_pylist()
            codes, scores = [], []
            for start, end in pieces(offsets):
                for k in range(start, end):
                    code, score = fit.predict(features(data[offsets[k] : offsets[k + 1]])) if lettered[k] else (UNKNOWN, 0.0)
                    codes.append(code)
                    scores.append(score)
            rest = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(codes, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    whole = whole_text(text)
    names = ["doc_id", *keep]
    # a text that is kept goes to the workers once
    read = text if text in keep and dict(docs.dtypes)[text] == "string" else "_text"
    df = docs.select(F.col(doc_id).alias("doc_id"), *keep, *([whole.alias("_text")] if read == "_text" else []), whole.rlike(r"\p{L}").alias("_lettered"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.mapInArrow(tidied(predict), f"{kinds}, lang_pred string, score double")
