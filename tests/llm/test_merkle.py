import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from crosstally.llm import merkle
from crosstally.llm.common import id_remainder

from .helpers import documents, empty

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, i):
    """The runs of two, and the place in them, on the way up from leaf i."""
    for level in levels[:-1]:
        first = i // 2 * 2
        yield i - first, level[first : first + 2]
        i //= 2


def brute(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H(*map(told, (r[0], r[3], r[2], n, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for x in langs}
    trees = {x: tree([leaf(r, r[4]) for r in members[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(members[x]):
            more = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, proof = leaf(r, r[4] + more if r[4] is not None else None), ""
            for at, run in [*steps(trees[x], i), *steps(top, k)]:
                proof += "".join(run[:at] + run[at + 1 :])
                folded = H(*run[:at], folded, *run[at + 1 :])
            out.append((r[0], leaf(r, r[4]), trees[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def found(df, **options):
    tampered = F.coalesce(id_remainder(F.col("doc_id"), 7) == 0, F.lit(False))
    return merkle.manifest(df, tampered, n_chars=F.col("n_chars").cast("decimal(20,0)") + 1, **options)


def same(df, rows, **options):
    got = sorted(map(str, map(tuple, found(df, **options).collect())))
    assert got == sorted(map(str, brute(rows))) and len(got) == len(rows)


def some(n, langs):
    rng = random.Random(n)
    rows = [(i if i % 13 else None, rng.choice([None, "", "héé" * i]), rng.choice(langs), rng.choice("ab"), None if i % 5 == 0 else i) for i in range(1, n)]
    return rows + rows[:3]


@pytest.mark.parametrize(("n", "langs", "options"), [
    (2, ["x"], {}),  # a row that is there twice is two leaves
    (300, [None, "a", "é", "\U0001f600", "", "b"], {"stride": 1}),  # level by level
    (300, [None, *"abcdefghijklmnopqrstuvwxyzABCDEFGHI"], {"stride": 3, "broadcast_rows": 10}),  # nothing is broadcast
    (700, ["a", "b"], {"stride": 2, "broadcast_rows": 300}),  # a climb by shuffle, and one by broadcast above it
])
def test_against_brute_force(spark, n, langs, options):
    rows = some(n, langs)
    same(spark.createDataFrame(rows, SCHEMA).repartition(3), rows, **options)


def test_awkward_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and other columns; tampering is found where it is, and only there."""
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    same(docs, rows)
    by = {r["doc_id"]: r["verified"] for r in found(docs).collect() if r["doc_id"] is not None}
    lengths = {r[0]: r[4] for r in rows}
    assert all(ok == (lengths[i] is None or zlib.crc32(str(i).encode()) % 7 != 0) for i, ok in by.items()) and not all(by.values())


def test_empty(spark):
    assert found(empty(spark)).collect() == []


def test_largest_count_is_tampered_without_overflow(spark):
    rows = [(i, "t", "x", "s", 2**63 - 1) for i in range(30)]
    same(spark.createDataFrame(rows, SCHEMA), rows)
