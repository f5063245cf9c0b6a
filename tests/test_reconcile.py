"""Golden fixture of the seven classes, properties on generated batches, fingerprints, repair loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crosstally.operators import fingerprint as fp
from crosstally.operators import reconcile as rc
from crosstally.operators import repair as rp
from crosstally.operators.paging import page
from crosstally.schemas import CLASSES, FIELDS, NORMALIZED_SCHEMA

AT = dt.datetime(2026, 8, 13, 12, 0, 1, 123456)


def record(i, sku, suffix="a", name="Café inventory", quantity=1, units=1234, at=AT, attrs=(("color", "Blå"), ("region", "MENA")), connector="con_reconciliation"):
    return (i, sku, name, quantity, units, "USD", 2, at, connector, f"source {sku} {suffix}", [{"key": k, "value": v} for k, v in attrs])


def frame(spark, rows):
    return spark.createDataFrame(rows, NORMALIZED_SCHEMA)


@pytest.fixture(scope="module")
def seven(spark):
    s = [record(0, "SKU-A"), record(1, "SKU-B", quantity=2), record(2, "SKU-C"), record(3, "SKU-E", "a"), record(4, "SKU-E", "b"), record(5, "SKU-F"), record(6, "SKU-G", "a"), record(7, "SKU-G", "b")]
    g = [record(0, "SKU-A"), record(1, "SKU-B", quantity=3), record(2, "SKU-D"), record(3, "SKU-E"), record(4, "SKU-F", "a"), record(5, "SKU-F", "b"), record(6, "SKU-G", "c"), record(7, "SKU-G", "d")]
    return frame(spark, s), frame(spark, g)


def classes(df):
    return {r["sku"]: r["classification"] for r in df.collect()}


def test_seven_classes(seven):
    out = rc.reconcile(*seven)
    assert classes(out) == dict(zip(["SKU-A", "SKU-B", "SKU-C", "SKU-D", "SKU-E", "SKU-F", "SKU-G"], CLASSES))
    flags = {r["sku"]: [f for f in FIELDS if r[f"{f}_mismatch"]] for r in out.collect()}
    assert {k: v for k, v in flags.items() if v} == {"SKU-B": ["quantity"]}
    assert rc.cross_check(out, *seven).count() == 0
    s = rc.reconciliation_summary(out)
    assert s.first().asDict() == {**dict.fromkeys(CLASSES, 1), "total": 7} and rc.check_summary_totals(s).count() == 0


def test_pages(seven):
    out, after, cursors = rc.reconcile(*seven), None, []
    while True:
        rows, after = page(out, ["sku"], after, 3)
        cursors.append(after)
        if after is None:
            break
    assert cursors == [("SKU-C",), ("SKU-F",), None]
    with pytest.raises(ValueError):
        page(out, ["sku"], None, 101)


def test_empty_sides(spark, seven):
    none = frame(spark, [])
    assert rc.reconcile(none, none).count() == 0
    assert set(classes(rc.reconcile(none, seven[1])).values()) == {"missing_from_source", "duplicate_target"}


def test_all_fields_in_order(spark):
    a = frame(spark, [record(0, "X")])
    b = frame(spark, [record(0, "X", name="o", quantity=9, units=1, at=AT + dt.timedelta(microseconds=1), attrs=(("color", "x"),))])
    assert [r["field"] for r in rc.field_differences(a, b).orderBy("position").collect()] == list(FIELDS)
    c = frame(spark, [record(5, "X", "other", attrs=(("region", "MENA"), ("color", "Blå")), connector="con_other")])
    assert classes(rc.reconcile(a, c)) == {"X": "match"}  # provenance and the order of attributes don't count
    assert rc.conflicts(rc.reconcile(a, b), a, b).first()["suggested_action"] == "update_target"


def test_duplicate_bound(spark):
    many = frame(spark, [record(i, "X", str(i)) for i in range(1025)] + [record(0, "Y")])
    one = frame(spark, [record(0, "X"), record(0, "Y")])
    out = rc.reconcile(many, one)
    assert [r["sku"] for r in rc.check_duplicate_bounds(out).collect()] == ["X"]
    with pytest.raises(ValueError, match="more than 1024 records"):
        rc.outcome_records(many, one)
    assert [r["sku"] for r in rc.outcome_records(many.filter("sku = 'Y'"), one.filter("sku = 'Y'")).collect()] == ["Y"]
    page = spark.range(102).selectExpr("concat('K', id) as sku")
    with pytest.raises(ValueError, match="at most 101"):
        rc.records_for(many, page)


def batch(seed, n=60):
    rng = random.Random(seed)
    return [record(i, f"K-{rng.randint(0, 30)}", str(i), rng.choice(["a", "b"]), rng.randint(0, 2), rng.randint(0, 2), AT + dt.timedelta(days=rng.randint(0, 1)), (("color", rng.choice(["x", "y"])),)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_properties(spark, seed):
    s, g = batch(seed), batch(seed + 10)
    out = rc.reconcile(frame(spark, s), frame(spark, g)).collect()
    assert sorted(r["sku"] for r in out) == sorted({r[1] for r in s + g})
    by = lambda rows, k: [r for r in rows if r[1] == k]
    for r in out:
        a, b = by(s, r["sku"]), by(g, r["sku"])
        assert (r["source_count"], r["target_count"]) == (len(a), len(b))
        if len(a) == len(b) == 1:
            x, y = a[0], b[0]
            diff = [x[2] != y[2], x[3] != y[3], x[4] != y[4], x[7] != y[7], x[10] != y[10]]
            assert [r[f"{f}_mismatch"] for f in FIELDS] == diff and r["classification"] == ("field_mismatch" if any(diff) else "match")
        else:
            assert not any(r[f"{f}_mismatch"] for f in FIELDS)
    shuffled = rc.reconcile(frame(spark, random.Random(0).sample(s, len(s))).repartition(5), frame(spark, g))
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, out))
    digest = lambda df: fp.inventory_fingerprint(df).first()["fingerprint"]
    d = digest(frame(spark, s))
    assert d == digest(frame(spark, s[::-1]).repartition(7)) and d != digest(frame(spark, s + s[:1])) and d != digest(frame(spark, s[1:]))
    assert digest(frame(spark, [])) == digest(frame(spark, [])) != d


def test_repair_loop(spark):
    s, g = frame(spark, batch(3)), frame(spark, batch(13))
    out = rc.reconcile(s, g)
    a = rp.generate_repairs(out, s, g, "f")
    assert a.count() == rc.repairable(out).count() > 0 and rp.check_actions(a).count() == 0 and rp.check_plan_uniqueness(a).count() == 0
    ledger = spark.createDataFrame([], "external_idempotency_key string, repair_action_id string, status string, found_sha256 string, after_sha256 string")
    new, entries = rp.apply_repairs(g, a, ledger)
    assert {r["status"] for r in entries.collect()} == {"applied"} and rp.verify_target(s, new).count() == 0
    rows = lambda df: sorted(map(str, df.select(*NORMALIZED_SCHEMA.names).collect()))
    again, more = rp.apply_repairs(new, a, entries)
    assert rows(again) == rows(new) and more.count() == 0
    stale, conflicts = rp.apply_repairs(new, a, ledger)  # without the ledger: everything changed meanwhile
    assert rows(stale) == rows(new) and {r["status"] for r in conflicts.collect()} == {"conflict"}
    assert rp.replay_conflicts(entries, entries).count() == 0
    assert rp.replay_conflicts(entries, entries.withColumn("after_sha256", F.lit("x"))).count() == entries.count()
    updates = a.withColumn("mismatches", rp.derived_mismatches(F.col("proposed_effect"), F.col("expected_effect")))
    assert rp.check_mismatch_evidence(updates).count() == 0
    assert rp.check_mismatch_evidence(updates.withColumn("mismatches", F.array(F.lit("sku")))).count() == a.filter("kind = 'update_target'").count()


def test_leaf_framing(spark):
    import hashlib

    got = spark.createDataFrame([("é",)], "x string").select(fp.leaf_digest(F.col("x")).alias("d")).first()["d"]
    assert got == hashlib.sha256(fp.LEAF.encode() + (2).to_bytes(8, "big") + "é".encode()).hexdigest()
