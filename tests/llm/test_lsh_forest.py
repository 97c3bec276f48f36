import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import components, lsh_forest
from tallymark.llm.shingles import shingles


def sets_of(texts, width=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute(texts, threshold=Fraction(4, 5)):
    sets = sets_of(texts)
    n = len(sets)
    root, links = list(range(n)), [0] * n

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and Fraction(common, len(sets[a] | sets[b])) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted(((k, top(k), links[k], len(sets[k])) for k in range(n)), key=repr)


def corpus(prose, seed=0, families=25):
    rng = random.Random(seed)
    texts = []
    for k in range(families):
        words = prose(rng.choice([6, 9, 15, 60, 200]), k).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                new[rng.randrange(len(new))] = "edit" + str(rng.randint(0, 99))
            texts.append(" ".join(new))
    texts += ["", None, " \n", "few words", "few words", "few words here", "one"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(documents, rows, clashing, prose, seed):
    texts = corpus(prose, seed)
    found = lsh_forest.join(clashing(documents(texts)))
    assert rows(found, "doc_id", "class_id", "links", "shingles") == brute(texts)


def test_large_groups_are_dealt_in_blocks(documents, rows, prose, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 16)
    words = prose(120, 3).split()
    texts = [" ".join(words[:k] + [f"edit{k}"] + words[k + 1 :]) for k in range(100)] + [" ".join(words)] * 30 + corpus(prose, 5, 5)
    found = lsh_forest.join(documents(texts))
    assert rows(found, "doc_id", "class_id", "links", "shingles") == brute(texts)


def test_prefix_is_shortened_to_the_target_recall():
    lengths = [lsh_forest.matched_length("0.8", r) for r in (0.5, 0.95, 0.999, 0.9999)]
    assert lengths == sorted(lengths, reverse=True) and lengths[0] == lsh_forest.DEPTH
    n = lsh_forest.matched_length("0.8", lsh_forest.RECALL)
    assert 1 - (1 - 0.8**n) ** lsh_forest.TREES >= lsh_forest.RECALL


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    factor, shift = rng.integers(1, 2**63, 600, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, 600, dtype=np.uint64)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = (np.frombuffer(lsh_forest.signature(s, factor, shift), ">u4") for s in (a, b))
    assert abs((x == y).mean() - 300 / 500) < 0.07


def test_shingles_are_sets_of_word_runs():
    texts = [None, "", "a b c d e f", "a b c d e", "b c d e f a b c d e", "x\ty\x0bz", "x y z", "é 😀 " * 40, "a b c d e f " * 3]
    # sliced and chunked columns give the same
    found = list(shingles(pa.array(["skip"] + texts).slice(1), 5))
    assert [len(f) for f in found] == [len(s) for s in sets_of(texts)]
    assert found[3][0] in found[2] and found[3][0] in found[4] and (found[5] == found[6]).all()
    again = [f for t in texts for f in shingles(pa.array([t], pa.string()), 5)]
    assert all((a == b).all() for a, b in zip(found, again, strict=True))


def test_block_counts_equal_set_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40), dtype=np.uint64)) for _ in range(30)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    off = ~np.eye(30, dtype=bool)
    assert (lsh_forest.intersections(sets)[off] == np.array(expected)[off]).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2200)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u int, v int")).collect()}
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert found == root


def test_repeated_rows_null_ids_and_no_rows(documents, rows, prose):
    text = prose(50, 1)
    found = lsh_forest.join(documents([text, text, text, None], ids=[3, 3, None, None]))
    assert rows(found, "doc_id", "class_id", "links") == sorted([(3, 3, 2), (3, 3, 2), (None, 3, 2), (None, None, 0)], key=repr)
    assert rows(lsh_forest.join(documents([]))) == [] and Counter(rows(lsh_forest.join(documents([""])), "class_id", "links")) == {(0, 0): 1}


def test_estimated_recall_counts_what_links_stand_for():
    assert lsh_forest.estimated_recall({}, 6, "0.8") == pytest.approx(lsh_forest.meeting(0.8, 6))
    few, many = lsh_forest.estimated_recall({99: 10}, 6, "0.8"), lsh_forest.estimated_recall({99: 10_000}, 6, "0.8")
    assert lsh_forest.meeting(0.8, 6) < few < lsh_forest.RECALL < many <= 1
    low = lsh_forest.estimated_recall({80: 10_000}, 6, "0.8")
    assert low == pytest.approx(lsh_forest.meeting(0.8, 6)) and lsh_forest.estimated_recall({80: 10_000}, 4, "0.8") >= lsh_forest.RECALL


@pytest.mark.parametrize(("edits", "expected"), [(0, [6]), (11, [6, 5, 4])])
def test_prefixes_are_shortened_as_far_as_the_links_found_ask(documents, rows, prose, monkeypatch, edits, expected):
    """Links of very similar sets prove the deepest level; links near the threshold ask for shorter prefixes."""
    levels, level_links = [], lsh_forest.level_links

    def noted(tries, sets, named, level, *rest):
        levels.append(level)
        return level_links(tries, sets, named, level, *rest)

    monkeypatch.setattr(lsh_forest, "level_links", noted)
    texts = []
    for k in range(6):
        words = prose(600, k).split()
        for n in range(12):
            new = list(words)
            for e in range(edits):
                new[n + 50 * e] = f"edit{n}"
            texts.append(" ".join([*new, f"end{n}"]))
    assert rows(lsh_forest.join(documents(texts)), "doc_id", "class_id", "links", "shingles") == brute(texts)
    assert levels == expected


def test_a_level_keeps_only_pairs_that_did_not_meet_before():
    rng = np.random.default_rng(7)
    for n in (2, 5, 40):
        signatures = rng.integers(0, 2, (n, 3, 4)).astype(np.uint32)
        for tree in range(3):
            for level in range(1, 5):
                side = rng.integers(0, 2, n).astype(bool)
                for sides in (None, side):
                    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if sides is None or side[a] != side[b]]
                    common = [[next((k for k in range(4) if signatures[a, t, k] != signatures[b, t, k]), 4) for t in range(3)] for a, b in pairs]
                    new = [max(c) <= level and max(c[:tree], default=0) < level for c in common]
                    left, right = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
                    assert (~lsh_forest.known(signatures, left, right, tree, level)).tolist() == new
                    assert lsh_forest.fresh(signatures, tree, level, sides).tolist() == sorted({x for p, keep in zip(pairs, new, strict=True) if keep for x in p})


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_recall_at_several_similarities(documents, similarity):
    """200 pairs each a little above a similarity: at least 0.9 of them are linked (in fact about all)."""
    rng = random.Random(int(similarity * 100))
    texts = []
    for k in range(200):
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(rng.randint(100, 400))]
        n = len(words) - 4
        edited = max(0, int((1 - similarity) * n / (1 + similarity)))  # of n shingles, so many are new in the edited text
        texts += [" ".join(words), " ".join([*words[: len(words) - edited], *(f"e{k}x{j}" for j in range(edited))])]
    found = lsh_forest.join(documents(texts)).collect()
    linked = sum(r["links"] for r in found) // 2
    assert linked == sum(links for _, _, links, _ in brute(texts)) // 2 or linked >= 0.99 * 200


def test_large_nodes_of_one_group_are_dealt_once_for_all_trees(documents, rows, prose, monkeypatch):
    """Near copies share large nodes in every tree: their sets go to pairs of blocks once, not once per tree."""
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 16)
    written, dealt = lsh_forest.written, []

    def noted(df, name):
        out = written(df, name)
        if name == "fresh":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(lsh_forest, "written", noted)
    texts = []
    for group in (3, 4):
        words = prose(150, group).split()
        texts += [" ".join(words[:k] + [f"edit{k}"] + words[k + 1 :]) for k in range(0, 150, 2)]
        texts += [" ".join(words[:k] + [f"more{k}"] + words[k + 1 : -k]) for k in range(1, 30)]
    texts += corpus(prose, 6, 5)
    assert rows(lsh_forest.join(documents(texts)), "doc_id", "class_id", "links", "shingles") == brute(texts)
    n, blocks = len(texts), -(-104 // 16) + 1
    assert sum(dealt) <= 2 * n * blocks


def test_a_clump_has_the_pairs_that_meet_in_any_tree():
    rng = np.random.default_rng(8)
    for n in (2, 5, 40):
        signatures = rng.integers(0, 2, (n, 3, 4)).astype(np.uint32)
        clump = rng.integers(-1, 2, n)
        for level in range(1, 5):
            for side in (None, rng.integers(0, 2, n).astype(bool)):
                pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if side is None or side[a] != side[b]]
                left, right = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
                common = [[next((k for k in range(4) if signatures[a, t, k] != signatures[b, t, k]), 4) for t in range(3)] for a, b in pairs]
                for tree in range(4):
                    apart = [clump[a] < 0 or clump[a] != clump[b] for a, b in pairs]
                    new = [max(c) == level for c in common] if tree == 3 else [max(c) <= level and max(c[:tree], default=0) < level and x for c, x in zip(common, apart, strict=True)]
                    assert (~lsh_forest.known(signatures, left, right, tree, level, clump)).tolist() == new
                    expected = sorted({x for p, keep in zip(pairs, new, strict=True) if keep for x in p})
                    assert lsh_forest.fresh(signatures, tree, level, side, clump).tolist() == expected


def test_nodes_that_share_few_sets_are_no_clump(spark, monkeypatch):
    """Two nodes of the same sets are dealt together; nodes of a chain, which would be more blocks together, stay apart."""
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 4)
    sets = {(0, b"a"): range(8), (1, b"a"): range(1, 9), (0, b"b"): range(100, 108), (1, b"b"): range(107, 115), (2, b"b"): range(114, 122), (2, b"c"): range(200, 203)}
    members = spark.createDataFrame(
        [(f"{r:03}".encode(), 1, t, p, -(-len(m) // 4)) for (t, p), m in sets.items() for r in m], "rep binary, shingles int, tree int, prefix binary, blocks int"
    )
    nodes = members.groupBy("tree", "prefix").count().selectExpr("tree", "prefix", "count as rows", "cast(ceil(count / 4) as int) as blocks")
    found = {bytes(r["rep"]): (bytes(r["clump"]), r["blocks"]) for r in lsh_forest.clumps(members, nodes, 3).collect()}
    assert sorted(found) == [f"{r:03}".encode() for r in range(9)] and {b for _, b in found.values()} == {3} and len(set(found.values())) == 1
    assert lsh_forest.clumps(members, nodes.filter("blocks = 1"), 3) is None


def test_block_of_many_links_takes_little_memory(monkeypatch):
    """All sets of two blocks are linked across them: links, roots and similarities are those of brute force, a stripe of pairs at a time."""
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(1, 2**63, int(k), dtype=np.uint64)])) for k in rng.integers(0, 8, 1500)]
    side, copies = np.arange(len(sets)) % 2 == 1, rng.integers(1, 4, len(sets))
    signatures = np.zeros((len(sets), 2, 3), np.uint32)
    signatures[:, :, 1:] = np.arange(len(sets), dtype=np.uint32)[:, None, None]
    tracemalloc.start()
    links, roots, hundredths = lsh_forest.verified(sets, signatures, side, copies, Fraction(4, 5), 0, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = np.array([len(s) - 60 for s in sets])
    near = (side[:, None] != side[None, :]) & (60 * 9 >= 4 * (120 + own[:, None] + own[None, :]))
    assert links.tolist() == (near * copies[None, :]).sum(axis=1).tolist()
    assert sorted(hundredths.tolist()) == sorted((6000 // (60 + own[:, None] + own[None, :]))[np.triu(near)].tolist())
    assert (roots == 0).sum() == near[0].any() + near.any(axis=1)[1:].sum()
    assert peak < 55 * len(sets) ** 2 / 2, peak
