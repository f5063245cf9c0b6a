import os
import random
import re

import pytest

from crosstally.llm import decontaminate as dc

from .helpers import ENGLISH, documents, empty

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window=10):
    w, hit, names = brute_words(text), set(), set()
    for name, t in items:
        b = brute_words(t)
        n = min(window, len(b))
        if not n:
            continue
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


def made(seed, n=60):
    """Small vocabulary, so that windows of few words often match."""
    rng = random.Random(seed)
    sentence = lambda k: " ".join(rng.choice(["Ab", "cd,", "é", "x1", "THE", "of"]) for _ in range(k))
    items = [(i, sentence(rng.choice([0, 1, 3, 5, 9, 10, 12, 30]))) for i in range(12)] + [(99, None), (None, "ab cd"), (3, "x1 x1 x1 x1")]
    docs = []
    for i in range(n):
        t = sentence(rng.randint(0, 80))
        if rng.random() < 0.5:
            _, item = rng.choice(items)
            cut = (item or "").split()
            a = rng.randint(0, max(0, len(cut) - 1))
            t = f"{t} {' '.join(cut[a : a + 15])} {sentence(5)}"
        docs.append((i, t))
    return docs, items


@pytest.mark.parametrize("seed,window,block", [(1, 4, 10**6), (2, 10, 10**6), (3, 5, 120)])
def test_matches_brute_force(spark, seed, window, block):
    docs, items = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in dc.contamination(d, b, window, block).collect()}
    known = [(n, t) for n, t in items if n is not None]
    assert got == {i: brute(t, known, window) for i, t in docs}
    clean = {r["doc_id"] for r in dc.decontaminated(d, b, window, block).collect()}
    assert clean == {i for i, (_, h, _) in got.items() if not h}


@pytest.mark.parametrize("seed", range(6))
def test_longest_matches_brute_force(spark, seed):
    docs, items = made(seed, 25)
    d = spark.createDataFrame(docs + [(None, docs[0][1])], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for name, t in items:
        w = brute_words(t)
        for i in range(len(w)) if name is not None else ():
            need = min(4, len(w))
            for doc, text in docs:
                x = brute_words(text)
                for p in range(len(x)):
                    n = 0
                    while i + n < len(w) and p + n < len(x) and w[i + n] == x[p + n]:
                        n += 1
                    if n >= need:
                        want[(str(name), i)] = max(want.get((str(name), i), (0, 0, 0)), (n, -doc, -p))
    for block in (10**6, 300):
        got = {(r["item_id"], r["item_word"]): (r["length"], -r["doc_id"], -r["doc_word"]) for r in dc.longest_matches(d, b, 4, block).collect()}
        assert got == want and want


def test_three_blocks_are_as_one(spark):
    docs, items = made(9, 80)
    d = spark.createDataFrame(docs + [(None, docs[3][1])], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert dc.Blocks(b, 4, 700).n >= 3
    rows = lambda n: sorted(map(str, dc.contamination(d, b, 4, n).collect()))
    assert rows(700) == rows(10**6)
    kept = lambda n: sorted(map(str, dc.decontaminated(d, b, 4, n).collect()))
    assert kept(700) == kept(10**6)


_MEASURE = """
import gc, os, pickle, random, sys, time
import numpy as np
from crosstally.llm import decontaminate as dc

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20

rng = random.Random(5)
letters = "abcdefghijklmnopqrstuvwxyz"
word = lambda: "".join(rng.choices(letters, k=5))
def items(total):
    for i in range(total // (dc.ITEM_BYTES + 606)):
        yield str(i), " ".join(word() for _ in range(100))
start = mb()
q = dc.Queries(items(int(sys.argv[1])))
driver = mb() - start
back = pickle.loads(pickle.dumps(q))
del q
gc.collect()
start = mb()
texts = [[w.encode() for w in (word() for _ in range(400))] for _ in range(1200)]
dc.Shard(texts, back).hits()
print(round(driver), round(mb() - start), len(back.vocabulary), len(back.ids))
"""


def test_a_block_is_small():
    """The largest block, whose words are nearly all different, in the driver and then in a worker with a shard of 3 MB: under 300 MB each."""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", _MEASURE, str(dc.BLOCK_BYTES)], capture_output=True, text=True, timeout=300, cwd=ROOT)
    driver, worker, different, n = map(int, out.stdout.split())
    assert different > 900_000 and n > 1_000_000 and driver < 300 and worker < 300, out.stdout


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, "start " + " ".join(f"w{i}" for i in range(5, 30)) + " end"), (2, " ".join(f"w{i}" for i in range(8, 20)))], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["item_word"]: (r["length"], r["doc_id"], r["doc_word"]) for r in dc.longest_matches(d, b).collect()}
    assert got[5] == (25, 1, 1) and got[10] == (20, 1, 6) and 25 not in got


def test_awkward_rows(spark):
    b = spark.createDataFrame([(1, ENGLISH), (2, None), (3, ""), (4, "two WORDS")], "item_id long, text string")
    docs = documents(spark)
    rows = dc.contamination(docs, b).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["item_ids"] == by[3]["item_ids"] == ["1"] and by[10]["item_ids"] == ["4"]
    assert by[6]["n_words"] == 0 and not by[6]["contaminated"] and by[9]["n_words"] == 120_000
    left = dc.decontaminated(docs, b)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect() if r["doc_id"]} == {4, 5, 6, 7, 8, 9, 11, 12, 13, 14}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(documents(spark), none).filter("contaminated").count() == 0
    assert dc.decontaminated(documents(spark), none).count() == documents(spark).count()
    assert dc.contamination(empty(spark), none).count() == 0
    assert dc.longest_matches(documents(spark), none).count() == 0
