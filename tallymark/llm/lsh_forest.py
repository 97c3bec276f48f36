"""Near-duplicate join: Jaccard similarity of word shingles by a MinHash LSH forest, verified exactly.

Each set has a signature per tree, of full depth. A tree is a prefix trie over the signatures of all sets: a node is a
prefix, its members the sets that begin with it. Matching starts at the deepest prefixes and shortens them level by
level; a level adds the pairs that share so long a prefix in some tree and no longer one in any. It ends when
the estimated recall is met: each link that was found has its exact similarity, and with it the chance that such a pair
meets at this level, so the links found stand for as many as the inverse of those chances sum up to. One link at the
threshold is counted beside them, so that few links prove little; at the length where even pairs at the threshold meet
with the target recall, matching ends in any case.

* Equal sets are one class from the start: their rows are counted, not compared.
* Nodes are found by aggregates (count, digest of the members); nodes of one member go, and so do nodes with exactly
  the members of a node of an earlier tree.
* A node is dealt out in blocks of bounded rows and shingles. A first pass compares two blocks by their signatures and
  keeps the members that have a pair not met before; only those get their shingles. A second one compares them by
  a matrix product over shingles, checks the similarity exactly, and returns sums per row and one link to a root per
  row, never pairs.
* Nodes of several blocks that share members, as those of one group of near copies in every tree do, are one clump if
  that deals fewer rows: its sets are dealt once, not once per tree, and a pair of it counts if it meets in any tree.
* Classes are the connected components of those links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.components import components
from tallymark.llm.shared import tidied, whole_text, written
from tallymark.llm.shingles import mixed, shingles

WIDTH, THRESHOLD, RECALL = 5, "0.8", 0.9995
TREES, DEPTH = 16, 6
#: What a block of a node holds, about: rows, shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Pairs of two blocks that are looked at together, and those whose signatures are.
STRIPE, SEEN = 1 << 18, 1 << 13


def matched_length(threshold: str, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, from the depth down, at which two sets at the threshold meet in at least one tree with the target recall."""
    length = depth
    while length > 1 and meeting(float(threshold), length, trees) < recall:
        length -= 1
    return length


def meeting(similarity: float, length: int, trees: int = TREES) -> float:
    """The chance that two sets share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def estimated_recall(found: dict[int, int], length: int, threshold: str, trees: int = TREES) -> float:
    """Links found, by hundredths of similarity, over the links that they stand for at this length; one link at the
    threshold, which may have been missed, counts beside them."""
    least = float(threshold)
    links = {1.0: 0, least: 0}
    for hundredth, n in found.items():
        similarity = max(least, hundredth / 100)
        links[similarity] = links.get(similarity, 0) + n
    links[least] += 1
    return sum(links.values()) / sum(n / meeting(s, length, trees) for s, n in links.items())


def sketches(docs: DataFrame, doc_id: str, text: str, width: int, values: int, row: str | None = None) -> DataFrame:
    """Per row: doc_id, number of distinct shingles, 128-bit digest of the set, signature; its row key if there is one."""
    rng = np.random.default_rng(values)
    factor = rng.integers(1, 2**63, values, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 2**63, values, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for found in shingles(batch.column("text"), width):
                sizes.append(len(found))
                digests.append(digest(found))
                signatures.append(signature(found, factor, shift))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), *(batch.column(c) for c in key)],
                names=["doc_id", "shingles", "rep", "signature", *key],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    key = ["row"] if row else []
    kinds = [f"row {docs.schema[row].dataType.simpleString()}"] if row else []
    columns = [F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"), *([F.col(row).alias("row")] if row else [])]
    return docs.select(*columns).mapInArrow(tidied(sketch), ", ".join([f"doc_id {kind}, shingles int, rep binary, signature binary", *kinds]))


def digest(found: np.ndarray) -> bytes:
    other = mixed(found + np.uint64(0x632BE59BD9B4E019))
    return np.array([found.sum() if len(found) else 0, other.sum() if len(found) else 0], np.uint64).tobytes()


def signature(found: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> bytes:
    """The smallest value of the set under each hash function."""
    least = np.full(len(factor), 2**32 - 1, np.uint32)
    for start in range(0, len(found), 2048):
        values = (found[start : start + 2048, None] * factor + shift) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=0).astype(np.uint32))
    return least.astype(">u4").tobytes()  # big-endian, so that bytes sort as values do


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(rep, shingles as bytes) of docs (text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingles(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["rep", "found"]
            )

    return docs.mapInArrow(tidied(sets), "rep binary, found binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, as a product of their incidence matrix, a slice of columns at a time."""
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    counts = np.bincount(where, minlength=len(values))
    shared = counts[where] > 1  # a shingle of one set alone meets nothing
    column = (np.cumsum(counts > 1) - 1)[where[shared]]
    rows = rows[shared]
    order = np.argsort(column, kind="stable")
    column, rows = column[order], rows[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, (1 << 22) // len(sets))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, [start, start + step])
        held = np.zeros((len(sets), step), np.float32)
        held[rows[low:high], column[low:high] - start] = 1
        out += held @ held.T
    return out


def known(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int, level: int, clump: np.ndarray | None = None) -> np.ndarray:
    """Whether each pair of rows, which share a prefix of this level in this tree, met before: at a deeper level in any tree, or
    at this one in an earlier tree or within a clump. signatures: rows by trees by depth; clump: a number per row, -1 if it is
    in none. The tree after the last stands for a clump: its pairs count as known if they do not meet at this level at all."""
    out = np.zeros(len(left), bool)
    trees, depth = signatures.shape[1:]
    for start in range(0, len(left), SEEN):
        one, other = left[start : start + SEEN], right[start : start + SEEN]
        same = signatures[one] == signatures[other]
        met = same[:, :tree, :level].all(axis=2).any(axis=1)
        if tree == trees:
            met = ~met
        elif clump is not None:
            met |= (clump[one] == clump[other]) & (clump[one] >= 0)
        if level < depth:
            met |= same[:, :, : level + 1].all(axis=2).any(axis=1)
        out[start : start + SEEN] = met
    return out


def fresh(signatures: np.ndarray, tree: int, level: int, side: np.ndarray | None, clump: np.ndarray | None = None) -> np.ndarray:
    """The rows of a block, or of two blocks if side tells them apart, that are in a pair which did not meet before."""
    n, trees, depth = signatures.shape
    if n <= 16:
        left, right = np.triu_indices(n, 1)
        if side is not None:
            crossing = side[left] != side[right]
            left, right = left[crossing], right[crossing]
        new = ~known(signatures, left, right, tree, level, clump)
        return np.unique(np.concatenate([left[new], right[new]]))
    new = ~np.eye(n, dtype=bool) if side is None else side[:, None] != side[None, :]

    def together(t: int, length: int) -> np.ndarray:
        names = np.ascontiguousarray(signatures[:, t, :length]).view(f"V{4 * length}").ravel()
        code = np.unique(names, return_inverse=True)[1]
        return code[:, None] == code[None, :]

    if tree == trees:
        meet = np.zeros((n, n), bool)
        for t in range(trees):
            meet |= together(t, level)
        new &= meet
    elif clump is not None:
        new &= (clump[:, None] != clump[None, :]) | (clump < 0)[:, None]
    for t in range(trees):
        length = level if t < tree < trees else level + 1
        if length <= depth:
            new &= ~together(t, length)
    return np.flatnonzero(new.any(axis=1))


def verified(
    sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray | None, copies: np.ndarray, threshold: Fraction, tree: int, level: int,
    clump: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links and the smallest linked row for each row of a block, or of two blocks if side tells them apart,
    and the similarity of each link in hundredths, rounded down. Pairs that met before are left out."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    a, b = threshold.numerator, threshold.denominator
    if n == 2:
        common = np.zeros((2, 2), np.int64)
        common[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        common = intersections(sets)
    links, roots, column = np.zeros(n), np.arange(n), np.arange(n)
    pairs, hundredths = [], [np.zeros(0, np.uint8)]
    step = max(1, STRIPE // n)
    for start in range(0, n, step):  # so many rows at a time that their pairs take little room
        part = common[start : start + step]
        near = part * (a + b) >= a * (sizes[start : start + step, None] + sizes[None, :])
        left, right = np.nonzero(near & (column[None, :] > column[start : start + step, None]))
        left += start
        if side is not None:
            crossing = side[left] != side[right]
            left, right = left[crossing], right[crossing]
        new = ~known(signatures, left, right, tree, level, clump)
        left, right = left[new], right[new]
        shared = part[left - start, right].astype(np.int64)
        hundredths.append((shared * 100 // (sizes[left] + sizes[right] - shared)).astype(np.uint8))
        links += np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
        pairs.append((left.astype(np.int32), right.astype(np.int32)))
    moved = True
    while moved:
        moved = False
        for left, right in pairs:
            low = np.minimum(roots[left], roots[right])
            if (roots[left] != low).any() or (roots[right] != low).any():
                np.minimum.at(roots, left, low)
                np.minimum.at(roots, right, low)
                roots, moved = roots[roots], True
    return links.astype(np.int64), roots, np.concatenate(hundredths)


def join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: str = THRESHOLD,
    recall: float = RECALL, trees: int = TREES, depth: int = DEPTH,
    row: str | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class), links, shingles; with a row key also row
    and stays, which is true for one row of each class, the first by key of those with that id.

    links counts the other rows whose set of shingles has at least the threshold's similarity, copies included. Words
    are runs without white space; a text of fewer words than the width has one shingle of them all, an empty or null
    text has none and stands alone. Repeated rows count as copies. A null id takes part; it is the class's id only if
    no other row of the class has one. Only the two named columns are read."""
    shortest = matched_length(threshold, recall, trees, depth)
    sketch = written(sketches(docs, doc_id, text, width, trees * depth, row), "sketches")
    first_row = [F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("first_row")] if row else []
    sets = written(
        sketch.filter("shingles > 0").groupBy("rep")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("shingles").alias("shingles"), F.first("signature").alias("signature"), *first_row),
        "sets",
    )

    # sizes say that sets below this many shingles have only equal partners
    limit = Fraction(threshold)
    least = next((n for n in range(1, 1000) if Fraction(n, n + 1) >= limit), 1000)
    path = [F.struct(F.lit(t).alias("tree"), F.substring("signature", 4 * depth * t + 1, 4 * depth).alias("path")) for t in range(trees)]
    paths = sets.filter(F.col("shingles") >= least).select("rep", "shingles", F.explode(F.array(*path)).alias("at")).select("rep", "shingles", "at.*")
    # what is alone at the shortest prefix is alone at every longer one
    shared = F.substring("path", 1, 4 * shortest).alias("prefix")
    crowded = paths.groupBy("tree", shared).count().filter("count > 1").drop("count")
    tries = paths.withColumn("prefix", shared).join(crowded, ["tree", "prefix"], "left_semi").drop("prefix")
    tries = written(tries, "tries")
    named = docs.select(F.col(doc_id).alias("_id"), whole_text(text).alias("text"))

    checked, found = None, {}
    for level in range(depth, shortest - 1, -1):
        links = written(level_links(tries, sets, named, level, trees, depth, width, limit), f"level-{level}")
        checked = links if checked is None else checked.unionByName(links)
        for r in links.filter("hundredth is not null").groupBy("hundredth").agg(F.sum("links").alias("n")).collect():  # at most 101 rows
            found[r["hundredth"]] = found.get(r["hundredth"], 0) + r["n"]
        if estimated_recall(found, level, threshold, trees) >= recall:
            break
    checked = checked.filter("hundredth is null")

    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ids = classes.groupBy("root").agg(F.min("first_id").alias("class_id"), *([F.min("first_row")["row"].alias("class_row")] if row else []))
    classes = classes.drop("first_row").join(ids, "root").join(links, "rep", "left").select(
        "rep", "class_id", *(["class_row"] if row else []), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    out = sketch.select("doc_id", "shingles", *(["row"] if row else []), F.when(F.col("shingles") > 0, F.col("rep")).alias("rep")).join(classes, "rep", "left")
    alone = F.col("shingles") == 0
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("shingles").cast("long").alias("shingles"),
        *(["row", (alone | (F.col("row") == F.col("class_row"))).alias("stays")] if row else []),
    )


def level_links(
    tries: DataFrame, sets: DataFrame, named: DataFrame, level: int, trees: int, depth: int, width: int, limit: Fraction,
) -> DataFrame:
    """What one level of the tries adds: rep, links and root per set of a block; hundredth and links for the similarities."""
    at = tries.select("rep", "shingles", "tree", F.substring("path", 1, 4 * level).alias("prefix"))
    nodes = at.groupBy("tree", "prefix").agg(
        F.count("*").alias("rows"), F.sum("shingles").alias("held"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    ).filter("rows > 1")
    nodes = nodes.groupBy("rows", "x", "y").agg(F.min(F.struct("tree", "prefix", "held")).alias("node")).select("node.*", "rows")
    nodes = written(nodes.withColumn("blocks", blocks_of("rows", "held")), "nodes")
    members = at.join(nodes.select("tree", "prefix", "blocks"), ["tree", "prefix"])
    clumped = clumps(members, nodes, trees)
    if clumped is None:
        signed = sets.select("rep", "signature", F.lit(None).cast("binary").alias("clump"))
        members = members.select("rep", "tree", "prefix", "blocks")
    else:
        signed = sets.select("rep", "signature").join(clumped.select("rep", "clump"), "rep", "left")
        # a large node of a clump is dealt with the clump, and not once more by itself
        alone = members.join(clumped.select("rep", "clump"), "rep", "left").filter("blocks = 1 or clump is null")
        members = alone.select("rep", "tree", "prefix", "blocks").unionByName(
            clumped.select("rep", F.lit(trees).alias("tree"), F.col("clump").alias("prefix"), "blocks")
        )

    block = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
    placed = members.join(signed, "rep").withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    key = ["tree", "prefix", "i", "j"]
    dealt = placed.select(
        "rep", "signature", "clump", "tree", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).alias("side"),
    ).repartition(*key).sortWithinPartitions(*key, "rep")
    kinds = "rep binary, tree int, prefix binary, i int, j int, side boolean, clump binary"
    new = written(dealt.mapInArrow(tidied(lambda batches: block_fresh(batches, trees, depth, level)), kinds), "fresh")

    needed = sets.join(new.select("rep").distinct(), "rep", "left_semi").select(F.col("first_id").alias("_first"))
    texts = named.join(needed, F.col("_id").eqNullSafe(F.col("_first")), "left_semi").select("text")
    held = shingle_sets(texts, width).groupBy("rep").agg(F.first("found").alias("found"))
    carried = held.join(sets.select("rep", "copies", "signature"), "rep")
    return (
        new.join(carried, "rep").repartition(*key).sortWithinPartitions(*key, "rep")
        .mapInArrow(tidied(lambda batches: block_links(batches, trees, depth, level, limit)), "rep binary, links long, root binary, hundredth int")
    )


def blocks_of(rows: str, held: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(held) / BLOCK_SHINGLES)).cast("int")


def clumps(members: DataFrame, nodes: DataFrame, trees: int) -> DataFrame | None:
    """(rep, clump, blocks) of the sets in nodes of several blocks that are dealt as clumps: the nodes that share members,
    directly or by others, unless dealing them one by one moves fewer rows. None if no node has several blocks."""
    large = nodes.filter("blocks > 1")
    if large.isEmpty():
        return None
    node = F.concat(F.encode(F.lpad(F.col("tree").cast("string"), 6, "0"), "utf-8"), F.col("prefix"))
    held = members.filter("blocks > 1").groupBy("rep").agg(F.first("shingles").alias("shingles"), F.collect_set(node).alias("nodes"))
    held = held.select("rep", "shingles", F.array_min("nodes").alias("first"), "nodes")
    links = held.select(F.col("first").alias("u"), F.explode("nodes").alias("v")).distinct()
    roots = components(links)  # a row per node that shares members with another one
    named = large.withColumn("node", node).join(roots, "node", "left").withColumn("clump", F.coalesce("root", "node"))
    named = written(named.select("node", "clump", (F.col("rows") * F.col("blocks")).alias("dealt")), "clumps")
    held = held.join(named.select(F.col("node").alias("first"), "clump"), "first").select("rep", "shingles", "clump")
    sizes = held.groupBy("clump").agg(F.count("*").alias("rows"), F.sum("shingles").alias("shingles")).withColumn("blocks", blocks_of("rows", "shingles"))
    alone = named.groupBy("clump").agg(F.sum("dealt").alias("dealt"))
    fewer = sizes.join(alone, "clump").filter("rows * blocks <= dealt").select("clump", "blocks")
    return written(held.select("rep", "clump").join(fewer, "clump"), "clumped")


def by_block(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by node and pair of blocks: (tree, prefix, i, j) with the rows of each, once they are complete."""
    current, rows = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("tree", "prefix", "i", "j")), strict=True)
        values = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        for key, value in zip(keys, values, strict=True):
            if key != current:
                if len(rows) > 1:
                    yield current, rows
                current, rows = key, []
            rows.append(value)
    if len(rows) > 1:
        yield current, rows


def stacked(signatures: list[bytes], trees: int, depth: int) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(len(signatures), trees, depth)


def numbered(clumps: list[bytes | None]) -> np.ndarray | None:
    """A number per clump, -1 for none; None if no row is in one."""
    if not any(clumps):
        return None
    numbers = {c: n for n, c in enumerate(dict.fromkeys(c for c in clumps if c))}
    return np.array([numbers[c] if c else -1 for c in clumps])


def block_fresh(batches: Iterator[pa.RecordBatch], trees: int, depth: int, level: int) -> Iterator[pa.RecordBatch]:
    """The members of each pair of blocks that have a pair not met before."""
    names = ["rep", "tree", "prefix", "i", "j", "side", "clump"]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for (tree, prefix, i, j), rows in by_block(batches, ("rep", "signature", "side", "clump")):
        side = np.array([r[2] for r in rows]) if i != j else None
        for k in fresh(stacked([r[1] for r in rows], trees, depth), tree, level, side, numbered([r[3] for r in rows])):
            out.append((rows[k][0], tree, prefix, i, j, rows[k][2], rows[k][3]))
        if len(out) >= 4096:
            yield batch()
            out = []
    if out:
        yield batch()


def block_links(batches: Iterator[pa.RecordBatch], trees: int, depth: int, level: int, threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Links, roots and similarities of each pair of blocks."""
    names, kinds = ["rep", "links", "root", "hundredth"], [pa.binary(), pa.int64(), pa.binary(), pa.int32()]
    out: list[tuple] = []
    total = np.zeros(101, np.int64)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for (tree, _, i, j), rows in by_block(batches, ("rep", "found", "signature", "copies", "side", "clump")):
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        side = np.array([r[4] for r in rows]) if i != j else None
        links, roots, hundredths = verified(
            sets, stacked([r[2] for r in rows], trees, depth), side, np.array([r[3] for r in rows]), threshold, tree, level, numbered([r[5] for r in rows])
        )
        total += np.bincount(hundredths, minlength=101)
        out.extend((rows[k][0], int(links[k]), rows[roots[k]][0], None) for k in np.flatnonzero(links))
        if len(out) >= 4096:
            yield batch()
            out = []
    out.extend((None, int(total[h]), None, int(h)) for h in np.flatnonzero(total))
    if out:
        yield batch()
