import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from crosstally.llm import jaccard as j

from .helpers import documents, empty


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([" ".join(words)] if words else [])


def brute(rows, percent=90):
    """(doc_id, n_shingles, component_id) of every row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and None not in (rows[a][0], rows[b][0]) and 100 * len(s & t) >= percent * len(s | t):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows))


def families(seed):
    """Copies, variants about the threshold on both sides, chains, common passages, short texts and unlike ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage, texts = [word() for _ in range(60)], []
    for n in (9, 10, 11, 12, 20, 31, 60, 120, 400):
        base = [word() for _ in range(n)]
        for _ in range(12):
            base = list(base) if rng.random() < 0.5 else base
            t = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                t[rng.randrange(len(t))] = word()
            texts += [t] * rng.choice([1, 1, 1, 3])
            if rng.random() < 0.3:
                base = t  # a chain
    texts += [[word() for _ in range(rng.randint(5, 40))] + passage + [word() for _ in range(rng.randint(0, 30))] for _ in range(60)]
    texts += [["a", "b"], ["a", "b"], ["a"], ["A"], [], ["a", "b", "c"], ["A", "b", "C"]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def found(df, **options):
    return Counter(map(tuple, j.near_documents(df, **options).select("doc_id", "n_shingles", "component_id").collect()))


def test_against_brute_force(spark, monkeypatch):
    """With blocks, groups and lists so small that each has several."""
    monkeypatch.setattr(j, "GROUP_TOKENS", 500)
    rows = families(3)
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=7) == want
    sizes = Counter(c for _, n, c in want.elements() if n > 5)
    assert max(sizes.values()) > 8 and sum(k == 1 for k in sizes.values()) > 50  # linked and unlinked ones are there


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)
    assert found(empty(spark)) == Counter()


def test_percent_is_bounded(spark):
    with pytest.raises(ValueError):
        j.near_documents(empty(spark), percent=20)


@pytest.mark.parametrize("seed", range(6))
def test_runs_count_any_split_into_batches(seed, monkeypatch):
    """Tokens of several classes, with their counts, whatever batches the rows come in; equal rows count once, long runs are saturated."""
    monkeypatch.setattr(j, "MANY", 20)
    rng = random.Random(seed)
    rows = sorted((t, n) for t in range(60) for n in rng.choices(range(200), k=rng.choice([1, 1, 2, 3, 30, 90])))
    cuts = sorted(rng.sample(range(len(rows)), 8))
    batches = [pd.DataFrame(rows[a:b], columns=["token", "node"], dtype="int64") for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    order = j.Order((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = sorted(t for b in j._runs(order)(iter(batches)) for t in b[["token", "node", "place"]].itertuples(index=False, name=None))
    df = Counter(t for t, _ in set(rows))
    assert got == sorted((t, n, min(df[t], 20)) for t, n in set(rows) if df[t] > 1)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_similar_sets_share_a_prefix_token_under_each_order(order):
    """The prefix that is sent, ranked by exact counts and frequent levels, never misses a link."""
    rng = np.random.default_rng(order)
    sets = []
    for n in (9, 15, 40, 300):
        base = rng.integers(0, 2**64, n, np.uint64)
        for _ in range(15):
            t = base.copy()
            t[: rng.integers(0, max(2, n // 18))] = rng.integers(0, 2**64, 1, np.uint64)
            sets.append(np.unique(t))
    turned = [j.turned(s, order) for s in sets]
    df = Counter(int(t) for s in turned for t in s)
    often = np.array(sorted(t for t, k in df.items() if k > 10), np.uint64)
    o = j.Order((often, np.array([int(np.log2(df[int(t)])) for t in often])))
    prefixes = []
    for s in turned:
        p = j.prefix_size(len(s))
        inside = int(np.searchsorted(s, o.edge))
        sent = o.sent(s[: max(inside, p)], p)
        place = o.place(sent, np.array([df[int(t)] for t in sent]))
        prefixes.append({int(sent[i]) for i in sorted(range(len(sent)), key=lambda i: (place[i], sent[i]))[:p]})
    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            if j.similar(sets[a], sets[b]):
                linked += 1
                assert prefixes[a] & prefixes[b]
    assert linked > 100


def test_sets_are_those_of_the_words():
    s = j.Shingles()
    texts = [None, "", " \t", "One", "one two", "ONE two", "one two three", "a b c a b c a b", "é É", "x " * 5000, "a b", "ab"]
    for a in texts:
        assert len(s.of(a)) == len(shingles(a))
        for b in texts:
            assert (shingles(a) == shingles(b)) == (len(s.of(a)) == len(s.of(b)) and (s.of(a) == s.of(b)).all())


def test_signatures_bound_differences(monkeypatch):
    """Signatures differ in at most as many bits as sets do in tokens, folded ones too."""
    monkeypatch.setattr(j, "SIGNED_BITS", 1024)
    rng = np.random.default_rng(5)
    for n in (9, 40, 300, 2000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.r_[a[n // 9 :], rng.integers(0, 2**64, n // 5, np.uint64)])
        x, y = j.signature(a), j.signature(b)
        while len(x) != len(y):
            x, y = (j.folded(x), y) if len(x) > len(y) else (x, j.folded(y))
        while True:
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
            if len(x) == 1:
                break
            x, y = j.folded(x), j.folded(y)
