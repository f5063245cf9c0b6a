"""Stored targets and fingerprint trees of which a change rewrites what it touches."""

import random

import pytest
from pyspark.sql import functions as F

from crosstally.operators import fingerprint as fp
from crosstally.operators import repair
from crosstally.plans.catalog import _ledger
from crosstally.schemas import NORMALIZED_SCHEMA
from crosstally.sources.buckets import BucketStore, hashed

from .test_history import T0


def test_versions_refer_to_untouched_buckets(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}", spark.range(1).select("id", F.lit("x").alias("v")).schema, F.col("id") % 16, 16)
    rows = spark.range(100).select("id", F.lit("old").alias("v"))
    assert store.publish(rows) == 0
    touched = store.buckets_of(spark.createDataFrame([(3,), (19,), (5,)], "id long"))
    assert touched == [3, 5]
    new = store.read(touched).filter("id % 16 <> 5").withColumn("v", F.lit("new"))
    assert store.publish(new, touched) == 1
    want = {i: "new" if i % 16 == 3 else "old" for i in range(100) if i % 16 != 5}
    assert {r["id"]: r["v"] for r in store.read().collect()} == want
    assert {r["v"] for r in store.read(version=0).collect()} == {"old"} and store.read(version=0).count() == 100
    assert store.held() == {b: 1 if b == 3 else 0 for b in range(16) if b != 5}
    assert {p.name for p in (tmp_path / "data" / "version=1").iterdir() if p.is_dir()} == {"bucket__=3"}
    assert all("version=1/bucket__=3" in f or "version=0" in f for f in store.read().inputFiles())
    with pytest.raises(Exception, match="(?i)exist"):  # a second writer of the same version
        other = BucketStore(spark, store.at, store.schema, store.bucket, 16)
        other.versions = lambda: [0]
        other.publish(new, touched)


def test_ten_actions_rewrite_ten_buckets_at_most(spark, tmp_path):
    """Of a target of 5 000 rows in 256 buckets; what they make is what a whole apply makes, and the tree follows."""
    row = lambda i, name: (i, f"K-{i}", name, 1, 1, "USD", 2, T0, "c", f"row {i}", [])
    target = spark.createDataFrame([row(i, "old") for i in range(5000)], NORMALIZED_SCHEMA)
    keys = [17, 400, 401, 999, 1234, 2500, 3000, 4444, 9001, 9002]
    new = spark.createDataFrame([row(i, "new") for i in keys], NORMALIZED_SCHEMA)
    known = target.select("sku", fp.effect_digest().alias("before"))
    a = new.select("sku", F.struct(*NORMALIZED_SCHEMA.names).alias("record"), fp.effect_digest().alias("after_sha256")).join(known, "sku", "left")
    kind = F.when(F.col("before").isNull(), "create_target").otherwise("update_target")
    a = a.select(F.col("sku").alias("canonical_key"), F.concat(F.lit("rac_"), "sku").alias("repair_action_id"), F.concat(F.lit("x"), "sku").alias("external_idempotency_key"), kind.alias("kind"), F.col("before").alias("before_sha256"), "after_sha256", "record")
    store = BucketStore(spark, f"file://{tmp_path}/t", NORMALIZED_SCHEMA, hashed("sku", 256), 256)
    tree = fp.StateTree(spark, f"file://{tmp_path}/f", "inventory")
    store.publish(target)
    tree.create(store.read(), fp.canonical_effect())
    version, entries = repair.apply_to_buckets(store, a, _ledger(spark), tree)
    assert {r["status"] for r in entries.collect()} == {"applied"} and entries.count() == 10
    assert sum(w == version for w in store.held().values()) <= 10
    assert sum(w > 0 for w in tree.leaves.held().values()) <= 18  # eight old leaves and ten new ones
    whole, _ = repair.apply_repairs(target, a, _ledger(spark))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, whole.collect()))
    assert tree.fingerprint().collect() == fp.inventory_fingerprint(whole).collect()


def test_a_tree_follows_verdicts_and_reads_the_target_once(spark, tmp_path, monkeypatch):
    """Actions that apply, that conflict, that the ledger has and that meet in one key: rows, entries and fingerprint are those of a whole apply, and no row of the target is read for the tree."""
    row = lambda sku, name, i=0: (i, sku, name, 1, 1, "USD", 2, T0, "c", f"row {i}", [])
    target = spark.createDataFrame([*(row(f"K-{i}", "old") for i in range(40)), row("K-7", "old", 1), row("K-8", "other", 1)], NORMALIZED_SCHEMA)
    wanted = [("K-1", "new", "update_target"), ("K-2", "new", "update_target"), ("K-2", "newer", "update_target"), ("K-3", "old", "update_target"), ("K-7", "new", "update_target"), ("K-8", "new", "update_target"), ("K-9", "late", "update_target"), ("K-10", "new", "create_target"), ("K-11", "done", "update_target"), ("N-1", "new", "create_target"), ("N-2", "new", "update_target")]
    new = spark.createDataFrame([row(sku, name, i) for i, (sku, name, _) in enumerate(wanted)], NORMALIZED_SCHEMA).select("record_index", F.struct(*NORMALIZED_SCHEMA.names).alias("record"), fp.effect_digest().alias("after_sha256"))
    said = spark.createDataFrame([(i, sku, kind, f"x{i}", name) for i, (sku, name, kind) in enumerate(wanted)], "record_index long, sku string, kind string, x string, name string")
    known = target.groupBy("sku").agg(F.min(fp.effect_digest()).alias("before"))
    a = said.join(new, "record_index").join(known, "sku", "left")
    before = F.when(F.col("kind") == "create_target", None).when(F.col("name") == "late", "another").otherwise(F.col("before"))
    a = a.select(F.col("sku").alias("canonical_key"), F.concat(F.lit("rac_"), "x").alias("repair_action_id"), F.col("x").alias("external_idempotency_key"), "kind", before.alias("before_sha256"), "after_sha256", "record")
    ledger = spark.createDataFrame([("x8", "rac_x8", "applied", None, None)], _ledger(spark).schema)
    store = BucketStore(spark, f"file://{tmp_path}/t", NORMALIZED_SCHEMA, hashed("sku", 4), 4)
    tree, reads, read = fp.StateTree(spark, f"file://{tmp_path}/f", "inventory", digits=1), [], store.read
    store.publish(target)
    tree.create(store.read(), fp.canonical_effect())
    monkeypatch.setattr(store, "read", lambda *x: reads.append(x) or read(*x))
    _, entries = repair.apply_to_buckets(store, a, ledger, tree)
    assert len(reads) == 1
    whole, told = repair.apply_repairs(target, a, ledger)
    assert sorted(map(str, read().collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, entries.collect())) == sorted(map(str, told.collect()))
    assert {r["external_idempotency_key"] for r in entries.collect() if r["status"] == "applied"} == {"x0", "x1", "x2", "x3", "x9"} and entries.count() == 10
    assert tree.fingerprint().collect() == fp.inventory_fingerprint(whole).collect()


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_nodes_of_other_buckets_stay(spark, tmp_path, digits):
    """A leaf added: its node is made again and every other is kept, in 16 buckets whatever the leaves' are."""
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "t string")
    tree, state = fp.StateTree(spark, f"file://{tmp_path}", "s", digits=digits), [f"r{i}" for i in range(300)]
    tree.create(df(state), F.col("t"))
    assert len(tree.update(df([]), df(["new"]), F.col("t"))) == 1
    assert len(tree.nodes.held()) <= 16 and sum(w == 1 for w in tree.nodes.held().values()) == 1
    assert tree.fingerprint().collect() == fp.state_fingerprint(df([*state, "new"]), F.col("t"), "s").collect()


def test_leaves_move_once_for_all_levels(spark):
    """A fingerprint's leaves are counted by one shuffle and move by one more to their nodes; a third brings the nodes together."""
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("t"))
    made = fp.state_fingerprint(df, F.col("t"), "s", "k")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert sum(r["n"] for r in made.collect()) == 100


def test_trees_follow_any_changes(spark, tmp_path):
    """Rounds of removed, added, repeated and equal rows: the stored tree's fingerprint is that of the whole state, the empty one too."""
    rng = random.Random(4)
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "t string")
    tree, state = fp.StateTree(spark, f"file://{tmp_path}", "s", digits=1), [f"r{rng.randrange(30)}" for _ in range(60)]
    same = lambda: tree.fingerprint().collect() == fp.state_fingerprint(df(state), F.col("t"), "s").collect()
    tree.create(df(state), F.col("t"))
    assert same()
    for gone, new in ((3, 2), (len(state) - 1, 0), (0, 5)):
        removed = rng.sample(state, gone)
        added = [f"n{rng.randrange(9)}" for _ in range(new)] + removed[:1]
        for x in removed:
            state.remove(x)
        state += added
        tree.update(df(removed), df(added), F.col("t"))
        assert same()
    with pytest.raises(ValueError):
        tree.update(df(["not there"]), df([]), F.col("t"))
    tree.update(df(state), df([]), F.col("t"))
    state = []
    assert same()
