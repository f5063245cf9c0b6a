"""Planted faults of the data model's rules, keys and references."""

import datetime as dt

from crosstally.operators import constraints as co
from crosstally.schemas import FOREIGN_KEYS, OPS_SCHEMAS, UNIQUE_KEYS

from .test_history import T0, ops

LATER, SHA = T0 + dt.timedelta(seconds=1), "a" * 64


def broken(name, df):
    return {(r["id"], r["rule"]) for r in co.check_rows(name, df).collect()}


def test_every_table_has_rules_and_keys():
    """Rules and keys name columns that the schemas have, but for the JSON texts and fingerprints that a table may carry beside them."""
    extra = {"final_fingerprint"} | {c for rules in co.RULES.values() for r in rules for c in r.columns if c.endswith("_json")}
    assert set(co.RULES) == set(OPS_SCHEMAS) == set(co.NAMED_BY)
    for name, rules in co.RULES.items():
        assert {c for r in rules for c in r.columns} <= set(OPS_SCHEMAS[name].names) | extra
        assert len({r.name for r in rules}) == len(rules)
    for child, columns, parent, others in FOREIGN_KEYS:
        assert set(columns) <= set(OPS_SCHEMAS[child].names) and set(others) <= set(OPS_SCHEMAS[parent].names)
    assert all(set(c) <= set(OPS_SCHEMAS[n].names) for n, c in UNIQUE_KEYS)


def test_runs(spark):
    good = {"run_id": "run_abc", "state": "queued", "row_version": 1, "plan_fingerprint": SHA, "created_at": T0}
    rows = [good, good | {"run_id": "run_-a"}, good | {"run_id": "run_b-1", "state": "lost"}, good | {"run_id": "run_c-1", "state": "failed"}, good | {"run_id": "run_d-1", "started_at": T0 - dt.timedelta(seconds=1), "row_version": 0}, good | {"run_id": "run_e-1", "plan_fingerprint": SHA.upper(), "created_at": None}]
    assert broken("runs", ops(spark, "runs", rows)) == {("run_-a", "run_id_shape"), ("run_b-1", "state_values"), ("run_c-1", "terminal_finish"), ("run_d-1", "started_at_order"), ("run_d-1", "row_version_range"), ("run_e-1", "plan_fingerprint_shape"), ("run_e-1", "created_at_present")}


def test_work_items_and_json(spark):
    good = {"work_item_id": "wrk_abc", "run_id": "run_abc", "node_id": "nod_abc", "partition_key": "p", "state": "pending", "row_version": 1, "completed_attempt_count": 2, "expected_checkpoint_version": 0}
    held = {"state": "running", "lease_owner": "o", "lease_expires_at": LATER, "active_attempt_number": 3, "active_attempt_started_at": T0}
    rows = [good, good | held | {"work_item_id": "wrk_abd"}, good | held | {"work_item_id": "wrk_abe", "lease_owner": None}, good | held | {"work_item_id": "wrk_abf", "active_attempt_number": 5}, good | held | {"work_item_id": "wrk_abg", "lease_expires_at": T0}, good | {"work_item_id": "wrk_abh", "available_at": T0}, good | {"work_item_id": "wrk_abi", "state": "leased", "partition_key": "x" * 129}]
    df = ops(spark, "work_items", rows)
    want = {("wrk_abe", "active_attempt"), ("wrk_abf", "active_attempt_number_order"), ("wrk_abg", "lease_time_order"), ("wrk_abh", "retry_time"), ("wrk_abi", "state_values"), ("wrk_abi", "partition_key_size")}
    assert broken("work_items", df) == want
    texts = {"wrk_abc": None, "wrk_abd": ' {"a": [1]}', "wrk_abe": "[1]", "wrk_abf": "{", "wrk_abg": "", "wrk_abh": "1", "wrk_abi": '{"a": 1} x'}
    told = df.join(spark.createDataFrame(list(texts.items()), "work_item_id string, input_reference_json string"), "work_item_id")
    assert broken("work_items", told) == want | {(k, "input_reference_json_object") for k in ("wrk_abe", "wrk_abf", "wrk_abg", "wrk_abh", "wrk_abi")}


def test_keys_of_the_model(spark):
    """Repeated keys and references to nothing, over one column and several; nulls refer to nothing."""
    runs = ops(spark, "runs", [{"run_id": "run_abc", "state": "queued", "created_at": T0}] * 2)
    head = {"run_id": "run_abc", "node_id": "nod_abc", "partition_key": "p", "version": 1}
    heads, marks = ops(spark, "checkpoint_heads", [head]), ops(spark, "checkpoints", [head, head | {"partition_key": "q"}, head | {"artifact_id": "art_abc", "version": 2}])
    manifests = ops(spark, "artifact_manifests", [{"artifact_id": "art_abc", "run_id": "run_abc", "node_id": "nod_xyz", "partition_key": "p", "relative_path": "a/b", "sha256": SHA, "media_type": "t"}])
    got = {(r["table"], r["rule"], r["id"]) for r in co.check_model({"runs": runs, "checkpoint_heads": heads, "checkpoints": marks, "artifact_manifests": manifests}).collect()}
    assert got == {("runs", "unique:run_id", "run_abc"), ("checkpoints", "foreign:run_id,node_id,partition_key", "run_abc/nod_abc/q"), ("checkpoints", "foreign:artifact_id,run_id,node_id,partition_key", "art_abc/run_abc/nod_abc/p")}
