"""The near-duplicate stage: its groups against brute force, its recall, and rows with awkward names."""

import random
from collections import Counter

from pyspark.sql import functions as F

from crosstally.llm import neardup
from crosstally.llm.decontaminate import decontaminated
from crosstally.llm.simhash import keep_first

from .helpers import documents, empty
from .test_jaccard import shingles
from .test_simhash import brute_print


def made(seed):
    """Documents of their own, exact copies, and near copies with one to eight words of each hundred changed."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, near = [], []
    for k in range(40):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        rows.append((10 * k, " ".join(base)))
        for i in range(1, rng.choice([1, 3, 5])):
            t = list(base)
            for _ in range(rng.randint(0, len(t) * 8 // 500)):
                t[rng.randrange(len(t))] = word()
            rows.append((10 * k + i, " ".join(t)))
            near.append((10 * k, 10 * k + i))
    return rows, near


def brute_groups(rows):
    """doc_id -> smallest doc_id reachable, by all pairs: fingerprints three bits apart at most, or five-word shingles of similarity 0.8."""
    prints, sets = [brute_print(t) for _, t in rows], [shingles(t, 5) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 3 or both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def test_groups_and_recall(spark):
    """Every group is that of all pairs; nine of ten planted near copies of similarity 0.8 or more are found, and none that isn't one."""
    rows, near = made(1)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_groups(rows)
    text = dict(rows)
    alike = [p for p in near if len(shingles(text[p[0]], 5) & shingles(text[p[1]], 5)) >= 0.8 * len(shingles(text[p[0]], 5) | shingles(text[p[1]], 5))]
    assert len(alike) > 30 and sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike)
    assert all(c // 10 == i // 10 for i, c in got.items())


def test_awkward_rows_and_names(spark):
    """Columns with dots, signs and our own inner names stay as they are, in this stage and in the next; rows without an id stay, an id has one row."""
    docs = documents(spark)
    names = {"score": "a.b", "size": "kept_id", "hits0": "hit_digest", "component_id": "kept_rows", "fp": "x`y z"}
    named = docs.withColumnsRenamed(names)
    kept = neardup.first_of_each(named)
    assert kept.columns == named.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[None] == 2 and ids[1] == 1 and not {2, 3, 6, 7} & set(ids) and {4, 5, 8, 9, 10, 11, 12, 13, 14} <= set(ids)
    bench = spark.createDataFrame([("i1", "seven wise old owls look on from the tall oak near"), ("i2", "pendant que sept vieux hiboux regardent depuis le grand chêne")], "item_id string, text string")
    clean = decontaminated(named, bench, block_bytes=150)  # two blocks
    assert clean.columns == named.columns and {r["doc_id"] for r in clean.collect()} >= {5, 8, 9} and not {1, 2, 4} & {r["doc_id"] for r in clean.collect()}
    assert neardup.first_of_each(empty(spark)).count() == 0


def test_equal_rows_and_rows_of_one_id(spark):
    rows = [(1, "b", "y"), (1, "b", "y"), (1, "b", "y"), (2, None, "x"), (2, "t", "x"), (3, "c", "q"), (3, "c", "p"), (4, "d", "d"), (None, "b", "y"), (None, "b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = keep_first(df.repartition(3), spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"))
    got = sorted(map(tuple, kept.collect()), key=str)
    assert [r[0] for r in got].count(None) == 2 and Counter(r[0] for r in got) == {1: 1, 2: 1, 3: 1, None: 2}
    assert (2, None, "x") in got and kept.columns == df.columns
    assert sorted(map(str, keep_first(df.repartition(1), df.select("doc_id").filter("doc_id < 4").distinct()).select(F.struct("*")).collect())) == sorted(map(str, keep_first(df.repartition(4), df.select("doc_id").filter("doc_id < 4").distinct()).select(F.struct("*")).collect()))


def test_few_kept_ids_are_met_by_a_shuffle_like_many(spark):
    """One plan for any number of ids, so what moves grows with the input and has no step."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    kept = keep_first(df, df.select("doc_id").filter("doc_id < 20"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and kept.count() == 20
