import random

import pytest
from pyspark.sql import functions as F

from crosstally.llm import mixing as mx

from .helpers import documents, empty


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped, target = {}, {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        weight = sum(w[s] for s in free)
        target = {s: left * w[s] / weight for s in free} if weight else {}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: 2.0 * sizes[s] for s in over}


def corpus(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "c", "hot", "hot", "hot", "B", None, "é", "z"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


@pytest.mark.parametrize("seed,n,fan", [(1, 400, 32), (2, 1500, 4), (3, 3, 32)])
def test_mix(spark, seed, n, fan):
    docs, rows = corpus(spark, seed, n)
    out = mx.mix(docs, fan=fan).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(n))
    sizes, taken, largest = {}, {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        if r["source_size"]:
            rate = r["target"] / r["source_size"]
            assert int(rate + 1e-9) <= r["copies"] <= rate + 1
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6  # only the last residual is rounded alone
    again = {(r["doc_id"], r["taken"]) for r in mx.mix(docs.repartition(7), fan=fan).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}


def test_rounding_is_unbiased(spark):
    """Over many independent sources of equal documents each document is taken as often as its fraction says."""
    parts = spark.range(6000).select(F.expr("cast(id div 12 as string)").alias("source"), F.struct(F.col("id").cast("string").alias("id"), F.col("id").alias("h"), F.lit(1).alias("k")).alias("row"), F.lit(10.0).alias("w"), F.lit(3.0).alias("m"))
    rows = mx.pivotal_round(parts, 4).collect()
    assert len(rows) == 6000
    assert sum(r["taken"] for r in rows) / 6000 == pytest.approx(0.3, abs=0.02)
    per = {}
    for r in rows:
        per[int(r["row"]["id"]) // 12] = per.get(int(r["row"]["id"]) // 12, 0) + r["taken"]
    assert set(per.values()) <= {3, 4}  # 3.6 of 12


def test_rows_that_are_equal(spark, monkeypatch):
    """Very many equal rows, with and without an id, are counted before they move, in parts; each is taken as the others are, but for one."""
    monkeypatch.setattr(mx, "PART", 100)
    rows = [(None, "w " * 10, "a")] * 950 + [(7, "w " * 10, "a")] * 30 + [(i, "w " * 5, "b") for i in range(100, 400)] + [(None, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mx.mix(docs).collect()
    assert len(out) == len(rows) and sum(r["doc_id"] is None for r in out) == 970
    taken, target = {}, {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 10 + 1e-6 for s in taken)
    key = lambda rs: sorted(str((r["doc_id"], r["source"], r["taken"])) for r in rs)
    assert key(mx.mix(docs.repartition(3)).collect()) == key(out)
    with pytest.raises(ValueError):
        mx.mix(docs, most=1.5)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = mx.mix(docs).collect()
    assert len(rows) == docs.count()
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["size"] == by[5]["size"] == by[7]["size"] == 0 and by[6]["taken"] == 0 and by[9]["size"] == 120_000


def test_empty(spark):
    assert mx.mix(empty(spark)).count() == 0
    assert mx.mix(empty(spark).unionByName(documents(spark).filter("text is null"))).filter("taken <> 0").count() == 0


def test_plan_is_native(spark):
    docs, _ = corpus(spark, 1, 50)
    plan = mx.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
