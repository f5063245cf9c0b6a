"""Queries and operators on groups and rows that the given tables are too small to have."""

import datetime as dt
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crosstally.operators import fingerprint, reconcile, repair
from crosstally.plans import catalog
from crosstally.schemas import NORMALIZED_SCHEMA


def test_every_block_of_a_long_run(spark, tmp_path):
    """h16: a run of 10 500 events has two blocks, and no event is left out."""
    e = spark.range(1, 10_501).selectExpr("id as event_id", "7L as user_id", "concat('k', id) as event_type", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "1.0D as value")
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["block"]: r["kinds"].split(",") for r in entry.queries()["h16_event_trace"](spark, str(tmp_path)).collect()}
    kept = [i for i in range(1, 10_501) if i % 97]
    assert got == {0: [f"k{i}" for i in kept if i <= 10_000], 1: [f"k{i}" for i in kept if i > 10_000]}


def plan_tables(spark, at, n):
    """One plan with n actions, one without any."""
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{at}/customer.parquet")
    spark.range(1, n + 1).selectExpr("id as o_orderkey", "1L as o_custkey", "'F' as o_orderstatus").write.parquet(f"{at}/orders.parquet")


def test_actions_of_a_plan_beyond_the_bound(spark, tmp_path):
    """x10: a plan of 10 500 actions has its first key; its blocks together hold every action once, in order, with its conflict's class."""
    d = str(tmp_path)
    plan_tables(spark, d, 10_500)
    got = {r["repair_plan_id"]: (r["n_actions"], r["first_key"]) for r in entry.queries()["x10_plan_details"](spark, d).collect()}
    assert got == {"rpl_1": (10_500, "SKU-1"), "rpl_2": (0, None)}
    p = repair.plan_details(catalog._plans(spark, d), catalog._approvals(spark, d), catalog._plan_actions(spark, d), catalog._plan_conflicts(spark, d), 1000)
    blocks = p.filter("repair_plan_id = 'rpl_1'").orderBy("block").collect()
    assert all(len(r["actions"]) <= 1000 and r["n_actions"] == 10_500 for r in blocks)
    assert [a["canonical_key"] for r in blocks for a in r["actions"]] == sorted(f"SKU-{i}" for i in range(1, 10_501))
    assert {a["classification"] for r in blocks for a in r["actions"]} == {"missing_from_target", "field_mismatch"}


def test_records_of_a_key_beyond_the_bound(spark):
    """A key with 3 000 records on a side keeps all of them, in order; r08 reads these blocks."""
    at = dt.datetime(2026, 1, 1)
    row = lambda i, sku, con: (i, sku, "n", 1, 1, "USD", 2, at, con, f"row {i}", [])
    a = spark.createDataFrame([row(i, "X", "a") for i in range(3000)] + [row(0, "Y", "a")], NORMALIZED_SCHEMA)
    b = spark.createDataFrame([row(i, "X", "b") for i in range(5)], NORMALIZED_SCHEMA)
    blocks = reconcile.record_blocks(a, b, 1024).orderBy("sku", "block").collect()
    assert all(len(r["source_records"]) + len(r["target_records"]) <= 1024 for r in blocks)
    x = [r for r in blocks if r["sku"] == "X"]
    assert [e["record_index"] for r in x for e in r["source_records"]] == list(range(3000)) and [e["record_index"] for r in x for e in r["target_records"]] == list(range(5))
    assert [(len(r["source_records"]), len(r["target_records"])) for r in blocks if r["sku"] == "Y"] == [(1, 0)]


def test_r08_counts_a_large_key(spark, tmp_path):
    """r08: 1 500 parts with one key are 1 500 records of its outcome, not a missing row."""
    spark.range(1500).selectExpr("1L as p_partkey", "'n' as p_name", "1 as p_size", "cast(1 as double) as p_retailprice", "'b' as p_brand", "'t' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r) for r in entry.queries()["r08_outcome_records"](spark, str(tmp_path)).collect()}
    assert got == {("P-1", 1500, 1500), ("S-1", 0, 1)}


def against_duckdb(spark, name, at):
    """The query's rows, which are those of its SQL over the same folder."""
    con = duckdb.connect()
    for f in os.listdir(at):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at}/{f}'")
    rows = entry.queries()[name](spark, at).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.execute(entry.oracle_sql()[name]).fetchall()))
    return rows


def test_findings_of_every_kind(spark):
    """l11: findings without a run are kept, and an expired lease of a partition with an artifact is told as such."""
    rows = against_duckdb(spark, "l11_all_recovery_findings", "/root/testdata/sf0.01")
    assert {r["kind"] for r in rows if r["run_id"] is None} == {f"integrity_{k}" for k in ("missing_file", "orphan_file", "changed_file", "unsafe_entry")} | {"stranded_idempotency", "event_frontier_corrupt"}
    assert any(r["kind"] == "work_expired_with_committed_artifact" for r in rows)


def test_chronology_reads_events_and_run_times(spark, tmp_path):
    """h05: an event before its run's creation is found, and so is the run that it makes start early."""
    spark.createDataFrame([(1, 7, "a", dt.datetime(1999, 1, 1)), (2, 8, "a", dt.datetime(2024, 1, 1))], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 1, dt.datetime(2001, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    assert {tuple(r) for r in entry.queries()["h05_chronology"](spark, str(tmp_path)).collect()} == {("event_before_run", "run_7/1"), ("run_times", "run_7")}


def test_exact_fingerprint_of_a_large_group(spark, tmp_path):
    """f06: nations of 12 000, 2 and (null) 1 customers, with copies; a group of more than 10 000 is no error."""
    rows = spark.range(12_003).selectExpr("id as c_custkey", "concat('Customer ', id % 11000) as c_name", "cast(case when id < 12000 then 1 when id < 12002 then 2 end as int) as c_nationkey")
    rows.repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["f06_exact_fingerprint"]).fetchall()
    got = list(map(tuple, entry.queries()["f06_exact_fingerprint"](spark, str(tmp_path)).collect()))
    assert sorted(map(str, got)) == sorted(map(str, want)) and {(k, n) for k, n, _ in got} == {(1, 12_000), (2, 2), (None, 1)}


def test_exact_fingerprint_without_rows(spark):
    """Without keys there is a fingerprint of no rows too, and it isn't that of one row."""
    of = lambda n: fingerprint.state_fingerprint_exact(spark.range(n), F.col("id").cast("string"), "s").first()
    assert of(0)["n"] == 0 and of(0)["fingerprint"] == hashlib.sha256(f"{fingerprint.ROOT}\ns\n0\n".encode()).hexdigest() and of(3)["n"] == 3 and of(3)["fingerprint"] != of(0)["fingerprint"]


def test_plans_without_actions_agree_with_sql(spark, tmp_path):
    """x10: a plan without any action has no first key, in the SQL too."""
    plan_tables(spark, str(tmp_path), 20)
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = con.execute(entry.oracle_sql()["x10_plan_details"]).fetchall()
    assert ("rpl_2", "person 2", 0, None, 0) in rows
    assert sorted(map(str, map(tuple, entry.queries()["x10_plan_details"](spark, str(tmp_path)).collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("name", ["x01_generate_repairs", "x02_check_actions", "x04_against_conflicts", "x08_idempotent_replay", "x14_mismatch_evidence", "f12_plan_content_fingerprint"])
def test_repairs_send_no_inventory_to_the_driver(spark, sf_dir, name):
    """Sides that grow with the tables meet by shuffles, however small their files are, and actions are derived once."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_update_of_an_absent_row_expects_nothing(spark, sf_dir):
    """Outcomes that tell an update of a key which the target no longer has give an action without a before, and that rule is told."""
    s, g = catalog._sides(spark, sf_dir)
    a = repair.generate_repairs(reconcile.reconcile(s, g), s, g.filter("false"), "f")
    rows = a.filter("kind = 'update_target'").select("before_sha256", "expected_effect").distinct().collect()
    assert [tuple(r) for r in rows] == [(None, None)] and {r["rule"] for r in repair.check_actions(a).select("rule").distinct().collect()} == {"update_without_before"}


def test_payloads_of_one_small_file_are_many_tasks_work(spark):
    """A file of few bytes has many rows: they are dealt to all cores before they are parsed."""
    from crosstally.operators import ingest

    text = F.to_json(F.struct(F.lit("P-1").alias("sku"), F.sha2(F.col("id").cast("string"), 512).alias("name"), F.lit("1").alias("quantity")))
    raw = spark.range(60_000).coalesce(1).select(F.col("id").alias("record_index"), F.lit("c").alias("connector_id"), F.lit("k").alias("source_record_key"), text.alias("payload_json"))
    tasks = ingest.normalize_inventory(raw).select("record_index", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count_distinct("record_index").alias("n")).collect()
    assert len(tasks) > 1 and sum(r["n"] for r in tasks) == 60_000


def test_rounds_of_repairs_read_stored_actions(spark, sf_dir):
    """The stored target's actions are a table: neither round nor tree joins the inventories again to learn them."""
    from crosstally.plans import files

    actions = files._stored_target(spark, sf_dir)[-1]
    assert "Join" not in actions._jdf.queryExecution().optimizedPlan().toString() and actions.count() == catalog._actions(spark, sf_dir).count() > 0
