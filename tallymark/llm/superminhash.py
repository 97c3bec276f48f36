"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union of classes.

SuperMinHash (Ertl, 2017) gives each element a random permutation of the places of the signature, drawn one rank at a
time. At rank j the element offers j plus a fraction at its place of that rank, and a place keeps its least offer. The
ranks of one element never share a place, which makes the estimate vary less than independent hash functions, most of
all for small sets. A set stops as soon as all its places hold offers of ranks already drawn: large sets need one or two.

Rows of a signature are cut into bands; sets that agree in a band meet in a node. Then:

* Equal sets are one class from the start. Nodes with the same members count once.
* Each node has a hub, its smallest member. All members are verified against the hub, dealt in parts of bounded rows, and
  linked ones form classes: a large group of near copies takes one comparison for each of its sets and hub, not all pairs.
* In nodes whose members still lie in several classes, sets of other classes than the hub's are compared with the rest in
  blocks. Jaccard distance obeys the triangle inequality, so members whose distances to the hub differ by more than the
  threshold allows cannot be linked and stay out: this loses no link.
* A document's component is the smallest id that the links reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.components import components
from tallymark.llm.lsh_forest import digest, intersections
from tallymark.llm.shared import keyed, whole_text, written
from tallymark.llm.shingles import mixed, shingles, utf8

WIDTH, PERCENT = 2, 80
#: Values of a signature and rows of a band: two sets at the threshold meet in some band with a chance of 0.9999.
VALUES, BAND = 72, 4
#: Bits of an offer's fraction; the rank stands above them.
FRACTION = 25
#: Rows that are compared with a hub at once; rows and shingles of a block of a node.
PART_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 64, 256, 1 << 19
#: Distances are floats: sets this close to the bound are compared.
SLACK = 1e-9
_STEP = 0x9E3779B97F4A7C15


def lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case."""
    data, offsets = utf8(texts)
    low = data[offsets[0] : offsets[-1]].copy()
    low[(low >= 65) & (low <= 90)] += 32
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(low.tobytes()))


def signatures(sets: list[np.ndarray], values: int = VALUES) -> np.ndarray:
    """A row of values for each set of 64-bit hashes; an empty set has the largest value everywhere."""
    n = len(sets)
    least = np.full(n * values, 2**32 - 1, np.uint32)
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    places = None
    for rank in range(values):
        if not len(x):
            break
        draw = mixed(x + np.uint64((rank + 1) * _STEP % 2**64))
        k = rank + ((draw >> np.uint64(32)) * np.uint64(values - rank) >> np.uint64(32)).astype(np.int64)
        if places is None:
            slot = k  # the permutation is untouched so far
        else:
            at = np.arange(len(x))
            slot = places[at, k].astype(np.int64)
            places[at, k] = places[:, rank]
        offer = (np.uint32(rank << FRACTION) | (draw & np.uint64((1 << FRACTION) - 1)).astype(np.uint32)).astype(np.uint32)
        np.minimum.at(least, row * values + slot, offer)
        # later ranks only offer more than a rank that is over
        open_ = least.reshape(n, values).max(axis=1) >= (rank + 1) << FRACTION
        going = open_[row]
        if places is None:
            x, row, k = x[going], row[going], k[going]
            places = np.tile(np.arange(values, dtype=np.uint8), (len(x), 1))
            places[np.arange(len(x)), k] = 0
        elif not going.all():
            x, row, places = x[going], row[going], places[going]
    return least.reshape(n, values)


def bands(least: np.ndarray, rows: int = BAND) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    n, values = least.shape
    cut = least.reshape(n, values // rows, rows).astype(np.uint64)
    out = np.zeros(cut.shape[:2], np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(_STEP) + cut[:, :, k] + np.uint64(k + 1))
    return out


def _parts(sets: list[np.ndarray], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of sets of about so many elements together."""
    start = held = 0
    for k, s in enumerate(sets):
        held += len(s) + 16
        if held > size:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(sets):
        yield start, len(sets)


def sketches(docs: DataFrame, width: int, values: int, rows: int) -> DataFrame:
    """Per row of docs (doc_id, text, row): doc_id, row, shingles, digest of the set, band hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles(lowered(batch.column("text")), width))
            hashes = [bands(signatures(sets[a:b], values), rows) for a, b in _parts(sets)]
            flat = np.concatenate(hashes).reshape(-1).view(np.int64) if hashes else np.zeros(0, np.int64)
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * (values // rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["doc_id", "row", "shingles", "rep", "bands"],
            )

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "row")}
    return docs.mapInArrow(sketch, f"doc_id {kinds['doc_id']}, row {kinds['row']}, shingles int, rep binary, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(rep, found) of docs (text): the digest of its set, and the set as bytes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingles(lowered(batch.column("text")), width))
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "found"])

    return docs.mapInArrow(sets, "rep binary, found binary")


def hub_links(percent: int):
    """Rows sorted by (hub, part), the hub's own first: near, and the distance of each other row to the hub."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            out = []
            for name, own, rep, found in zip(*(batch.column(c).to_pylist() for c in ("hub", "own", "rep", "found")), strict=True):
                found = np.frombuffer(found, np.uint64)
                if own:
                    hub, held = name, found
                    continue
                assert name == hub  # its own row came before
                at = np.searchsorted(held, found)
                at[at == len(held)] = 0
                common = int((held[at] == found).sum())
                union = len(held) + len(found) - common
                out.append((hub, rep, 100 * common >= percent * union, 1 - common / union))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.bool_(), pa.float64()), strict=True)], names=["hub", "rep", "near", "distance"]
            )

    return check


def block_links(percent: int):
    """Rows sorted by (tree, prefix, i, j): links between the classes of probes and of the rows that they are compared with."""

    def linked(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        probe = np.array([r[0] for r in rows])
        if probe.all() or not probe.any():
            return []
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        root = np.unique([r[1] for r in rows], return_inverse=True)[1]
        size = np.array([len(s) for s in sets])
        common = intersections(sets)
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        near &= probe[:, None] & ~probe[None, :] & (root[:, None] != root[None, :])
        left, right = np.nonzero(near)
        # one link for each pair of classes
        pairs = np.unique(np.stack([np.minimum(root[left], root[right]), np.maximum(root[left], root[right])], axis=1), axis=0)
        names = {int(r): rows[k][1] for k, r in enumerate(root)}
        return [(names[a], names[b]) for a, b in pairs.tolist()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["u", "v"])

        current, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("tree", "prefix", "i", "j")), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in ("probe", "root", "found")), strict=True)
            for key, value in zip(keys, values, strict=True):
                if key != current:
                    if rows:
                        yield out(linked(rows))
                    current, rows = key, []
                rows.append(value)
        if rows:
            yield out(linked(rows))

    return check


def _blocks(rows: str, held: str):
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(held) / BLOCK_SHINGLES)).cast("int")


def _with_sets(rows: DataFrame, carried: DataFrame) -> DataFrame:
    # neither side grows small: both are sorted
    return rows.join(carried.hint("merge"), "rep")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, values: int = VALUES, band: int = BAND,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A-Z are lowered; words are runs without white space; a text with fewer words than the width has one shingle of them all,
    an empty or null text has none and is linked with nothing. Sets are linked if 100 * intersection >= percent * union,
    counted on whole sets. Repeated rows are copies of each other. A null id takes part and names a component only if no
    other row of it has one; kept compares null-safely, and holds for each of several rows with the component's id. Shingles
    are compared as 64-bit hashes. Further columns are not read."""
    key = next(n for n in (f"row_{k}" for k in range(len(docs.columns) + 1)) if n not in map(str.lower, docs.columns))
    named = keyed(docs, key).select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"), F.col(key).alias("row"))
    sketch = written(sketches(named, width, values, band), "sketches")
    sets = written(
        sketch.filter("shingles > 0").groupBy("rep")
        .agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")),
        "sets",
    )

    # a set of fewer shingles than this is only like its equals
    least = next((n for n in range(1, 1000) if 100 * n >= percent * (n + 1)), 1000)
    meets = sets.filter(F.col("shingles") >= least).select("rep", "shingles", F.posexplode("bands").alias("tree", "prefix"))
    nodes = meets.groupBy("tree", "prefix").agg(
        F.count("*").alias("rows"), F.min("rep").alias("hub"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    ).filter("rows > 1")
    nodes = nodes.groupBy("rows", "hub", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("node")).select("node.*", "rows", "hub")
    members = written(meets.join(nodes, ["tree", "prefix"]), "members")

    needed = sets.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("row").alias("_row"))
    texts = named.join(needed, F.col("row") == F.col("_row"), "left_semi").select("text")
    carried = written(shingle_sets(texts, width), "carried")

    pairs = written(members.filter("rep <> hub").select("hub", "rep").distinct(), "pairs")
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    dealt = pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"))
    own = dealt.select("hub", F.col("hub").alias("rep"), "part").distinct()
    sides = dealt.withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)))
    checked = _with_sets(sides, carried).repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("own"))
    checked = written(checked.mapInArrow(hub_links(percent), "hub binary, rep binary, near boolean, distance double"), "checked")
    first = written(components(checked.filter("near").select(F.col("hub").alias("u"), F.col("rep").alias("v"))), "roots")

    links = written(_links_beside_hubs(members, checked, first, carried, percent), "links")
    last = components(links)

    classes = sets.select("rep", "first_id").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = classes.join(last.select(F.col("node").alias("root"), F.col("root").alias("_last")), "root", "left").withColumn("root", F.coalesce("_last", "root"))
    ids = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(ids, "root").select("rep", "component_id")
    out = sketch.select("doc_id", "shingles", F.when(F.col("shingles") > 0, F.col("rep")).alias("rep")).join(classes, "rep", "left")
    component = F.when(F.col("shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("shingles").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _links_beside_hubs(members: DataFrame, checked: DataFrame, first: DataFrame, carried: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes whose members meet in a node, beside those that its hub showed."""
    node = ["tree", "prefix"]
    placed = members.filter("rows > 2").join(checked.select("hub", "rep", "distance"), ["hub", "rep"], "left")
    placed = placed.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = written(placed.select(*node, "rep", "hub", "shingles", "root", F.coalesce("distance", F.lit(0.0)).alias("distance")), "placed")
    several = placed.groupBy(*node).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("root"))).alias("hub_root"))
    # the hub itself has met them all
    rest = placed.join(several.filter("lo <> hi"), node).filter("rep <> hub").withColumn("probe", F.col("root") != F.col("hub_root"))
    nearest = rest.groupBy(*node).agg(F.min(F.when(F.col("probe"), F.col("distance"))).alias("nearest"))
    reach = (100 - percent) / 100 + SLACK
    rest = written(rest.join(nearest, node).filter(F.col("probe") | (F.col("distance") >= F.col("nearest") - reach)).select(*node, "rep", "shingles", "root", "probe"), "rest")
    sizes = rest.groupBy(*node).agg(
        F.count("*").alias("n"), F.sum("shingles").alias("held"),
        F.count(F.when(F.col("probe"), 1)).alias("probes"), F.sum(F.when(F.col("probe"), F.col("shingles"))).alias("probes_held"),
    ).filter("n > 1").select(*node, _blocks("probes", "probes_held").alias("across"), _blocks("n", "held").alias("down"))
    rest = rest.join(sizes, node)
    i, j = (F.pmod(F.xxhash64("rep", F.lit(k)), F.col(c)).cast("int") for k, c in ((1, "across"), (2, "down")))
    probes = rest.filter("probe").withColumn("i", i).withColumn("j", F.explode(F.expr("sequence(0, down - 1)")))
    others = rest.withColumn("probe", F.lit(False)).withColumn("j", j).withColumn("i", F.explode(F.expr("sequence(0, across - 1)")))
    columns = [*node, "i", "j", "probe", "root", "rep"]
    both = _with_sets(probes.select(*columns).unionByName(others.select(*columns)), carried)
    return both.repartition(*node, "i", "j").sortWithinPartitions(*node, "i", "j").mapInArrow(block_links(percent), "u binary, v binary")
