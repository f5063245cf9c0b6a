import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from crosstally.llm import simhash as sh

from .helpers import documents, empty


def brute_print(text):
    words = (text or "").encode().decode().translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    """node -> smallest node reachable, by all pairs."""
    parent = {n: n for n, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if ((f ^ g) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n, _ in prints}


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one  TWO", "É é Ü ü", *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)) for n in (3, 4, 50, 400))]
    assert [sh.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def test_long_texts_are_counted_whole():
    text = " ".join(f"w{i}" for i in range(sh._COUNTED + 5000))
    assert sh.fingerprint(text) == brute_print(text)


def test_anchors_cover():
    """Every 31-bit piece has one code word within one bit, and the anchors are all code words within two bits."""
    rng = np.random.default_rng(3)
    pieces = rng.integers(0, 2**31, 200)
    row, anchor, home = sh.anchors_of(pieces)
    assert (sh._syndrome(anchor) == 0).all()
    distance = np.bitwise_count(pieces[row] ^ anchor)
    assert (distance[home] <= 1).all() and home.sum() == len(pieces)
    assert (distance <= 2).all()
    for i, p in enumerate(pieces[:20]):
        near = {int(p) ^ m for m in [0, *(1 << a for a in range(31)), *((1 << a) | (1 << b) for a in range(31) for b in range(a))]}
        words = np.array(sorted(near))
        assert set(words[sh._syndrome(words) == 0].tolist()) == set(anchor[row == i].tolist())


@pytest.mark.parametrize("block", [2048, 7])
def test_components_match_brute_force(spark, block):
    rng = random.Random(5)
    prints, node = [], 0
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            node += 1
            prints.append((node, f))
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
    prints = list({f: (n, f) for n, f in reversed(prints)}.values())
    df = spark.createDataFrame([(n, f - 2**64 if f >= 2**63 else f) for n, f in prints], "node long, fp long")
    found = {r["node"]: r["component"] for r in sh.components(sh.links(df, block=block)).collect()}
    want = brute_components(prints)
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert found == {n: c for n, c in want.items() if sizes[c] > 1}


def test_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r["node"], r["component"]) for r in sh.components(edges).collect()} == {(i, 0) for i in range(n + 1)}


def test_spanning_edges_are_few():
    fps = np.arange(8, dtype=np.int64)
    edges = sh.spanning_edges(fps, fps)
    assert len(edges) == 7


def test_awkward_rows(spark):
    docs = documents(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in sh.near_duplicates(docs).collect())
    by = {i: c for null, i, c in got if not null}
    assert len(got) == docs.count()
    assert by[1] == by[2] == by[3] == 1  # copies, and case doesn't count
    assert by[5] == by[6] == by[7] == 5  # no words: fingerprint zero
    assert all(c is None for null, _, c in got if null)
    kept = sh.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(None) == 2 and 2 not in ids and 3 not in ids and 6 not in ids
    assert {4, 8, 9, 10, 11, 12, 13, 14} <= set(ids)


def test_empty(spark):
    assert sh.near_duplicates(empty(spark)).count() == 0
    assert sh.first_of_each(empty(spark)).count() == 0


def test_one_id_with_several_texts(spark):
    """Whatever the order and the partitions, the same row of an id stays."""
    rows = [(1, "alpha beta gamma delta", "a"), (1, "one two three four five", "b"), (1, None, "c"), (2, "alpha beta gamma delta", "d"), (3, "quite another text here", "x"), (3, "quite another text here", "w")]
    kept = []
    for k in range(4):
        random.Random(k).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(k + 1)
        kept.append(sorted(map(tuple, sh.first_of_each(df).collect())))
    assert all(x == kept[0] for x in kept) and [r[0] for r in kept[0]] == [1, 3] and kept[0][0][1] is None


def test_away_pairs_are_left_to_other_anchors():
    """Links with an end at home are all found; two fingerprints away from home aren't compared."""
    fps, nodes = np.array([0, 1, 3, 7 << 20, (7 << 20) | 1], np.int64), np.arange(5)
    edges = sh.spanning_edges(fps, nodes, np.array([1, 0, 0, 0, 0]))
    assert {frozenset(e) for e in edges} == {frozenset((0, 1)), frozenset((0, 2)), frozenset((0, 3))}
    assert sh.spanning_edges(fps, nodes, np.zeros(5)) == []


def test_threshold_is_bounded(spark):
    with pytest.raises(ValueError):
        sh.links(spark.createDataFrame([(1, 1)], "node long, fp long"), threshold=4)
