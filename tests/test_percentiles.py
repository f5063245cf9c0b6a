"""Exact percentiles and ranks of groups of any size."""

import random

import pytest
from pyspark.sql import functions as F

from crosstally.operators import runstats as rs


def nearest(values, p):
    values = sorted(v for v in values if v is not None)
    return values[(len(values) * p + 99) // 100 - 1] if values else None


def made(seed):
    """Groups of one value, few and many different values, negative and extreme ones, nulls, and a null key."""
    rng = random.Random(seed)
    groups = {
        "one": [7] * 50,
        "few": [rng.choice([1, 2, 2, 9]) for _ in range(200)],
        "many": rng.sample(range(10**9), 700),
        "signs": [rng.randint(-500, 500) for _ in range(300)],
        "ends": [-(2**63), 2**63 - 1, 0, -1, 1] * 3,
        "nulls": [None, 5, None, 3, None],
        "empty": [None, None],
        None: [rng.randrange(10**5) for _ in range(150)],
    }
    return groups, [("r", k, v) for k, vs in groups.items() for v in vs]


@pytest.mark.parametrize("large", [0, 160, rs.LARGE])
def test_percentiles_by_digits_are_those_by_sorting(spark, large):
    groups, rows = made(large)
    df = spark.createDataFrame(rows, "run_id string, node_id string, duration_microseconds long").repartition(5)
    got = {r["node_id"]: (r["attempts"], *(r[f"p{p}_microseconds"] for p in rs.PERCENTS)) for r in rs.percentiles(df, ["run_id", "node_id"], large=large).collect()}
    assert got == {k: (len(v), *(nearest(v, p) for p in rs.PERCENTS)) for k, v in groups.items()}


@pytest.mark.parametrize("values", [[], [None], [4], [-3, -3]])
def test_few_values(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "k string, duration_microseconds long")
    got = [tuple(r) for r in rs.percentiles(df, ["k"], large=0).collect()]
    assert got == ([("a", len(values), *(nearest(values, p) for p in rs.PERCENTS))] if values else [])


def test_one_hot_key_with_millions_of_different_durations(spark):
    """All but a few rows are of one key and no two durations are equal; no buffer holds more than one digit's counts."""
    n = 2_000_000
    hot = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % n * 1009 + 13).alias("duration_microseconds"))
    df = hot.unionByName(spark.createDataFrame([("cold", 3), ("cold", 1)], "k string, duration_microseconds long"))
    got = {r["k"]: tuple(r)[1:] for r in rs.percentiles(df, ["k"]).collect()}
    at = lambda p: ((n * p + 99) // 100 - 1) * 1009 + 13
    assert got == {"hot": (n, at(50), at(95), at(99)), "cold": (2, 1, 3, 3)}
    counted = rs.selected(df, ["k"], "duration_microseconds")
    assert "percentile" not in counted._jdf.queryExecution().toString() and counted.count() == 6


@pytest.mark.parametrize("partitions", [1, 7])
def test_ranks_over_several_ranges(spark, partitions):
    """Ranks are those of a sort, with ties, nulls and null keys, however many ranges a key fills; no window sees a key's rows."""
    rng = random.Random(partitions)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"w{i % 97:03}", i, rng.choice([None, 1, 1, 1, rng.randrange(10**6)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, work_item_id string, attempt_number int, duration_microseconds long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ranked = rs.ranked_attempts(df, "k")
        got = {r["attempt_number"]: (r["rank"], r["of"]) for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[3] is not None, r[3] or 0, r[1], r[2]))
        want |= {r[2]: (i + 1, len(mine)) for i, r in enumerate(mine)}
    assert got == want
