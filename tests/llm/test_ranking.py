import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crosstally.llm import ranking

from .helpers import documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """item -> its (score, doc_id) list by the formula, over all pairs."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, length = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for name, text in items:
        if name is not None:
            asked.setdefault(str(name), set()).update(terms(text))
    out = {}
    for name, ts in asked.items():
        found = []
        for i, c, size in held:
            m = 100 - 90 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        found.sort()
        out[name] = [(None if null else i, -s) for s, null, i in found[:k]]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        rows = out.setdefault(str(r["item_id"]), [])
        assert r["rank"] == len(rows) + 1
        rows.append((r["doc_id"], r["score"]))
    return out


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda a, b: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(a, b)))
    docs = [(i, text(0, 80)) for i in range(n)]
    docs += [(n + i, docs[0][1] + " copy") for i in range(40)]  # equal scores
    return docs, [(f"q{i}", text(1, 12)) for i in range(25)] + [("none", "!!"), ("other", "absent term"), ("q1", "w59 more")]


@pytest.mark.parametrize(("entries", "block_bytes", "parts"), [(ranking.CHUNK_ENTRIES, ranking.BLOCK_BYTES, 3), (150, 1500, 5)])
def test_against_brute_force(spark, entries, block_bytes, parts):
    docs, items = made(1, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = told(ranking.ranked(d, spark.createDataFrame(items, "item_id string, text string"), entries=entries, block_bytes=block_bytes))
    assert got == {k: v for k, v in brute(docs, items).items() if v}


def test_awkward_rows(spark):
    docs = documents(spark)
    items = [(1, "Quick BROWN fox"), (2, None), (3, ""), (4, "--"), (5, "é"), (6, "tie word5x5 licence"), (None, "fox"), (1, "chien"), (7, "the tie two")]
    b = spark.createDataFrame([(i, t, "x", 1.0, 0) for i, t in items], "item_id int, text string, doc_id string, score double, rank int")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = ranking.ranked(docs, b)
    assert dict(found.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    want = {k: v for k, v in brute(rows, items).items() if v}
    assert told(found) == want and want["1"][0][0] is not None and any(i is None for i, _ in want["1"])


def test_empty(spark):
    b = spark.createDataFrame([("a", "fox")], "item_id string, text string")
    assert ranking.ranked(empty(spark), b).collect() == []
    assert ranking.ranked(documents(spark), b.limit(0)).collect() == []


def test_tree_shares_paths_and_bounds_hold():
    """Each node's maxima and minimum bound every document below it, shared paths are one node, and the search leaves documents out."""
    docs, items = made(7, 400)
    block = ranking.Items((n, t) for n, t in items)
    counted = [(i, [block.vocabulary[t.encode()] for t in terms(x) if t.encode() in block.vocabulary], len(terms(x))) for i, x in docs]
    counted = [x for x in counted if x[2]]
    df = Counter(t for _, ts, _ in counted for t in set(ts))
    post = ranking.Postings(block, dict(df), len(counted), sum(n for *_, n in counted))

    def nodes():
        for i, ts, n in counted:
            c = Counter(int(post.rank[t]) for t in ts)
            ranks = np.array(sorted(c), np.int64)
            yield ranking.Node(ranks, np.array([c[r] for r in ranks.tolist()], np.int64), 10 + (90 * n * post.n_docs) // post.length, i, 0, [])

    tree, inner = ranking.fp_tree(list(nodes())), 0
    stack = [(tree, [])]
    while stack:
        node, above = stack.pop()
        scores = post.scores(node.terms, node.tf, node.m)
        assert all((bound >= scores).all() for bound in above)
        inner += bool(node.children) and node.depth > 0
        stack += [(c, [*above, scores]) for c in node.children]
    assert inner > 50
    best = ranking.Best(len(block.names), 10)
    assert ranking.search(tree, post, best) < len(counted)
    assert {n: [(k, -s) for s, k in rows] for n, rows in zip(block.names, best.rows)} == brute(docs, items)
