"""Registered queries of the operators, each over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import artifacts, constraints, fingerprint, history, ingest, paging, reconcile, recovery, repair, runstats
from ..schemas import CLASSES, WORK_TRANSITIONS
from ..session import long_rows
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_OUT = "sku, source_count, target_count, classification, name_mismatch, quantity_mismatch, unit_price_mismatch, updated_at_mismatch, attributes_mismatch"
INV, OPS, EVS, IDEM, FILES = (f"WITH {x}" for x in (v.SQL_INVENTORY, v.SQL_OPS, v.SQL_EVENTS, v.SQL_IDEM, v.SQL_FILES))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return v.inv_reference(spark, d), v.inv_target(spark, d)


# --- reconciliation


@query(f"{INV} SELECT {_OUT} FROM outcome")
def r06_reconcile(spark, d):
    return reconcile.reconcile(*_sides(spark, d))


@query(f"{INV} SELECT sku, n, name AS first_name, quantity AS first_quantity, units AS first_units FROM ts")
def r01_aggregate_side(spark, d):
    a = reconcile.aggregate_side(v.inv_target(spark, d))
    return a.select("sku", "n", F.col("first.name").alias("first_name"), F.col("first.quantity").alias("first_quantity"), F.col("first.unit_price.unit_price_minor_units").alias("first_units"))


_DIFF = " UNION ALL ".join(
    f"SELECT sku, {i} AS position, '{f}' AS field, {a} AS source_value, {b} AS target_value FROM flags WHERE {f}_mismatch"
    for i, (f, a, b) in enumerate(
        [("name", "s_name", "t_name"), ("quantity", "CAST(s_quantity AS VARCHAR)", "CAST(t_quantity AS VARCHAR)"), ("unit_price", "concat(s_units, '|USD|2')", "concat(t_units, '|USD|2')")]
        + [("attributes", *(f"""concat('[{{"key":"brand","value":"', {s}_brand, '"}},{{"key":"type","value":"', {s}_type, '"}}]')""" for s in "st"))]
    )
).replace("3 AS position, 'attributes'", "4 AS position, 'attributes'")


@query(f"{INV} {_DIFF}")
def r07_field_differences(spark, d):
    return reconcile.field_differences(*_sides(spark, d))


@query(f"{INV} SELECT sku, source_count AS n_source, target_count AS n_target FROM outcome")
def r08_outcome_records(spark, d):
    r = reconcile.record_blocks(*_sides(spark, d))
    return r.groupBy("sku").agg(F.sum(F.size("source_records")).alias("n_source"), F.sum(F.size("target_records")).alias("n_target"))


@query(f"{INV} SELECT sku, source_count, target_count FROM outcome WHERE source_count > 1 OR target_count > 1")
def r09_duplicate_bounds(spark, d):
    return reconcile.check_duplicate_bounds(reconcile.reconcile(*_sides(spark, d)), 1)


@query(f"{INV} SELECT sku, classification FROM outcome WHERE sku > 'P-1' ORDER BY sku LIMIT 101")
def r10_outcome_page(spark, d):
    return paging.page_frame(reconcile.reconcile(*_sides(spark, d)), ["sku"], ("P-1",), 100).select("sku", "classification")


@query(f"{INV}, p AS (SELECT sku FROM outcome WHERE sku > 'P-1' ORDER BY sku LIMIT 100) SELECT sku, k * 2 + copy AS record_index, name, quantity FROM tgt WHERE sku IN (SELECT sku FROM p)")
def r11_records_for_page(spark, d):
    s, g = _sides(spark, d)
    page = paging.after_cursor(reconcile.reconcile(s, g), ["sku"], ("P-1",)).orderBy("sku").limit(100)
    return reconcile.records_for(g, page).select("sku", "record_index", "name", "quantity")


@query(f"{INV}, odd AS (SELECT * FROM outcome WHERE sku LIKE '%7' AND classification <> 'match') SELECT {_OUT}, 'check' AS only_in FROM odd UNION ALL SELECT {_OUT.replace('classification', chr(39) + 'match' + chr(39))}, 'outcomes' FROM odd")
def r12_cross_check(spark, d):
    """Outcomes of which some were altered to a match: exactly these are told, as they are and as they should be."""
    s, g = _sides(spark, d)
    altered = reconcile.reconcile(s, g).withColumn("classification", F.when(F.col("sku").like("%7"), "match").otherwise(F.col("classification")))
    return reconcile.cross_check(altered, s, g)


@query(f"{INV} SELECT sku, classification FROM outcome WHERE classification IN ('missing_from_target', 'field_mismatch')")
def r13_repairable(spark, d):
    return reconcile.repairable(reconcile.reconcile(*_sides(spark, d))).select("sku", "classification")


@query(f"{INV} SELECT {', '.join(f'''count(*) FILTER (classification = '{c}') AS {c}''' for c in CLASSES)}, count(*) AS total FROM outcome")
def r14_summary(spark, d):
    return reconcile.reconciliation_summary(reconcile.reconcile(*_sides(spark, d)))


@query(
    f"{INV} SELECT sha256(concat(sku, '|', classification)) AS conflict_id, sku AS canonical_key, classification, CASE classification WHEN 'missing_from_target' THEN 'create_target' WHEN 'field_mismatch' THEN 'update_target' ELSE 'none' END AS suggested_action, "
    f"CAST(name_mismatch AS INTEGER) + CAST(quantity_mismatch AS INTEGER) + CAST(unit_price_mismatch AS INTEGER) + CAST(attributes_mismatch AS INTEGER) AS n_differences FROM outcome WHERE classification <> 'match'"
)
def r15_conflicts(spark, d):
    s, g = _sides(spark, d)
    c = reconcile.conflicts(reconcile.reconcile(s, g), s, g)
    return c.select("conflict_id", "canonical_key", "classification", "suggested_action", F.coalesce(F.json_array_length("differences"), F.lit(0)).alias("n_differences"))


@query("SELECT 'orders.parquet' AS file, count(*) + 1 AS row_count, count(*) AS found FROM orders")
def r16_row_counts(spark, d):
    orders = v.table(spark, d, "orders")
    said = orders.agg((F.count("*") + 1).alias("row_count")).select(F.lit("in/orders.parquet").alias("relative_path"), "row_count")
    found = reconcile.check_row_counts(orders, said)
    return found.groupBy().agg(F.lit("orders.parquet").alias("file"), F.max("row_count").alias("row_count"), F.sum("found").alias("found"))


@query("SELECT * FROM (VALUES ('mixed_owner', CAST(NULL AS VARCHAR)), ('too_many_files', NULL)) AS x(rule, detail) WHERE (SELECT count(*) FROM orders) > 1100")
def r17_manifest_set(spark, d):
    return reconcile.check_manifest_set(v.ops_manifests(spark, d))


@query(f"{INV} SELECT sku, 1 AS source_count, 0 AS target_count, 'missing_from_target' AS classification FROM rs WHERE n = 1 UNION ALL SELECT sku, n, 0, 'duplicate_source' FROM rs WHERE n > 1")
def r18_empty_target(spark, d):
    s, g = _sides(spark, d)
    return reconcile.reconcile(s, g.filter("false")).select("sku", "source_count", "target_count", "classification")


@query(f"{INV} SELECT sku AS canonical_key, classification FROM outcome WHERE classification = 'duplicate_target' ORDER BY sku LIMIT 51")
def r19_conflict_listing(spark, d):
    s, g = _sides(spark, d)
    c = reconcile.conflicts(reconcile.reconcile(s, g), s, g).filter("classification = 'duplicate_target'")
    return paging.page_frame(c, ["canonical_key"], None, 50).select("canonical_key", "classification")


# --- canonical texts and fingerprints

_EFFECT = """concat('{"attributes":[{"key":"brand","value":"', brand, '"},{"key":"type","value":"', type, '"}],"name":"', name, '","quantity":', quantity, ',"sku":"', sku, '","unit_price":{"currency":"USD","exponent":2,"minor_units":', units, '},"updated_at":"', strftime(make_timestamp(%d + k * 1000000), '%%Y-%%m-%%dT%%H:%%M:%%S.%%fZ'), '"}')""" % v.DAY0


@query(f"{INV} SELECT sku, copy, {_EFFECT} AS effect, sha256({_EFFECT}) AS digest FROM tgt")
def f02_canonical_effect(spark, d):
    return v.inv_target(spark, d).select("sku", (F.col("record_index") % 2).cast("int").alias("copy"), fingerprint.canonical_effect().alias("effect"), fingerprint.effect_digest().alias("digest"))


@query("""WITH """ + v.SQL_INVENTORY + f""" SELECT sku, copy, concat('{{"effect":', {_EFFECT}, ',"provenance":{{"connector_id":"con_reference","source_record_key":"row ', k, ' ', copy, '"}}}}') AS record FROM ref""")
def f01_canonical_record(spark, d):
    return v.inv_reference(spark, d).select("sku", (F.col("record_index") % 2).cast("int").alias("copy"), fingerprint.canonical_record().alias("record"))




def _leaf_sql(text: str) -> str:
    return f"sha256(encode('{fingerprint.LEAF}') || unhex(lpad(printf('%x', octet_length(encode({text}))), 16, '0')) || encode({text}))"


def fingerprint_sql(ctes: str, rows: str, text: str, scope: str, keys: str = "") -> str:
    """The state fingerprint of a relation's texts in DuckDB, for each value of the comma-separated keys."""
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    level = f"{ctes}, level0 AS (SELECT {k}leaf AS name, copies, concat(leaf, 'x', copies) AS line FROM (SELECT {k}{_leaf_sql(f"concat('{scope}', chr(10), {text})")} AS leaf, count(*) AS copies FROM {rows} GROUP BY ALL))"
    for i, digits in enumerate(fingerprint.LEVELS):
        level += f""",
made{i} AS (SELECT {k}substr(name, 1, {digits}) AS node, CAST(sum(copies) AS BIGINT) AS c, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM level{i} GROUP BY ALL),
level{i + 1} AS (SELECT {k}node AS name, c AS copies, concat(node, ':', c, ':', d) AS line FROM made{i})"""
    return f"""{level}
SELECT {k}CAST(coalesce(sum(copies), 0) AS BIGINT) AS n, sha256(concat_ws(chr(10), '{fingerprint.ROOT}', '{scope}', CAST(coalesce(sum(copies), 0) AS VARCHAR), coalesce(string_agg(line, chr(10) ORDER BY line), ''))) AS fingerprint FROM level{len(fingerprint.LEVELS)} {g}"""


def _json_sql(texts: dict[str, str], numbers: dict[str, str]) -> str:
    """Canonical JSON of columns, given as SQL; names in alphabetical order."""
    shown = {k: f"CASE WHEN {e} IS NULL THEN 'null' ELSE concat('\"', {e}, '\"') END" for k, e in texts.items()}
    shown |= {k: f"coalesce(CAST({e} AS VARCHAR), 'null')" for k, e in numbers.items()}
    return "concat('{', " + ", ',', ".join(f"'\"{k}\":', {shown[k]}" for k in sorted(shown)) + ", '}')"


def _parts_sql(ctes: str, parts: dict[str, tuple[str, str, str]], keys: str = "") -> str:
    """The digest over several relations' fingerprints: name -> (relation, text, scope)."""
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    lines = " UNION ALL ".join(f"SELECT {k}concat_ws(':', '{name}', CAST(n AS VARCHAR), fingerprint) AS line FROM ({fingerprint_sql(ctes, rows, text, scope, keys)})" for name, (rows, text, scope) in parts.items())
    return f"SELECT {k}sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM ({lines}) {g}"


@query(f"{INV} SELECT sku, k * 2 + copy AS record_index, {_leaf_sql('name')} AS leaf FROM tgt")
def f04_leaf_digest(spark, d):
    return v.inv_target(spark, d).select("sku", "record_index", fingerprint.leaf_digest(F.col("name")).alias("leaf"))


@query(fingerprint_sql(f"{INV}, x AS (SELECT substr(sku, 1, 1) AS kind, {_EFFECT} AS e FROM tgt)", "x", "e", "inventory", "kind"))
def f05_state_fingerprint(spark, d):
    return fingerprint.inventory_fingerprint(v.inv_target(spark, d).withColumn("kind", F.substring("sku", 1, 1)), "kind")


_LEAF = _leaf_sql("concat('customers', chr(10), c_name)")


@query(f"SELECT c_nationkey, count(*) AS n, sha256(concat_ws(chr(10), '{fingerprint.ROOT}', 'customers', CAST(count(*) AS VARCHAR), string_agg({_LEAF}, chr(10) ORDER BY {_LEAF}))) AS fingerprint FROM customer GROUP BY 1")
def f06_exact_fingerprint(spark, d):
    return fingerprint.state_fingerprint_exact(v.table(spark, d, "customer"), F.col("c_name"), "customers", "c_nationkey")


_OUTCOME = """concat('{"attributes_mismatch":', attributes_mismatch, ',"classification":"', classification, '","name_mismatch":', name_mismatch, ',"quantity_mismatch":', quantity_mismatch, ',"sku":"', sku, '","source_count":', source_count, ',"target_count":', target_count, ',"unit_price_mismatch":', unit_price_mismatch, ',"updated_at_mismatch":', updated_at_mismatch, '}')"""


@query(fingerprint_sql(INV, "outcome", _OUTCOME, "reconciliation", "classification"))
def f06_reconciliation_fingerprint(spark, d):
    return fingerprint.reconciliation_fingerprint(reconcile.reconcile(*_sides(spark, d)), "classification")


@query(f"{INV} SELECT sku, {_OUTCOME} AS outcome FROM outcome")
def f07_canonical_outcome(spark, d):
    return reconcile.reconcile(*_sides(spark, d)).select("sku", fingerprint.canonical_outcome().alias("outcome"))


_MANIFEST = """concat('{"artifact_id":"art_', o_orderkey, '","byte_size":', o_orderkey * 10, ',"media_type":"application/vnd.apache.parquet","node_id":"nod_', o_custkey % 8, '","partition_key":"partition-', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '","relative_path":"runs/', o_custkey, '/part-', o_orderkey, '.parquet","row_count":', o_orderkey, ',"run_id":"run_', o_custkey % 3, '","schema_version":1,"sha256":"', sha256(CAST(o_orderkey AS VARCHAR)), '"}')"""


@query(fingerprint_sql("WITH o AS (SELECT * FROM orders WHERE o_orderkey % 41 <> 0)", "o", _MANIFEST, "manifests"))
def f08_manifest_set_digest(spark, d):
    return fingerprint.manifest_set_digest(v.ops_manifests(spark, d))


def _ops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return v.ops_runs(spark, d), v.ops_nodes(spark, d), v.ops_work(spark, d), v.ops_attempts(spark, d)


def _iso(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%fZ')"


_RUNS = f"{OPS}, runs_x AS (SELECT run_id, state, min(started_at) AS began, CASE WHEN state = 'succeeded' THEN max(finished_at) END AS ended FROM runs JOIN att USING (run_id) GROUP BY 1, 2)"
_SOURCE = _parts_sql(
    _RUNS,
    {
        "runs": ("runs_x", _json_sql({"run_id": "run_id", "state": "state", "created_at": _iso("began"), "started_at": _iso("began"), "finished_at": _iso("ended")}, {"row_version": "1"}), "runs"),
        "nodes": (
            "nod",
            _json_sql(
                {"node_id": "node_id", "status": "status"},
                {c: c for c in ("work_total", "work_pending", "work_running", "work_succeeded", "work_quarantined", "work_failed", "work_cancelled", "retry_count")}
                | {"duration_microseconds": "CAST(duration_microseconds AS BIGINT)", "row_version": "1", "records_read": "attempts * 10", "records_written": "attempts * 9", "records_quarantined": "attempts", "bytes_read": "attempts * 1000", "bytes_written": "attempts * 900"},
            ),
            "nodes",
        ),
        "work": ("wrk", _json_sql({"work_item_id": "work_item_id", "node_id": "node_id", "state": "state"}, {"completed_attempt_count": "completed_attempt_count"}), "work"),
        "attempts": ("att", _json_sql({"work_item_id": "work_item_id", "outcome": "outcome"}, {"attempt_number": "attempt_number", "duration_microseconds": "duration_microseconds"}), "attempts"),
    },
    "run_id",
)


@query(_SOURCE)
def f09_source_digest(spark, d):
    return fingerprint.source_digest(*_ops(spark, d))


@query(f"SELECT run_id, sha256(concat_ws(chr(10), '1', digest, 'node_statistics', 'run_summary')) AS query_digest FROM ({_SOURCE})")
def f10_query_digest(spark, d):
    r = fingerprint.source_digest(*_ops(spark, d))
    return r.select("run_id", fingerprint.query_digest(F.col("digest"), "1", "node_statistics", "run_summary").alias("query_digest"))


@query(
    _parts_sql(
        OPS,
        {
            "runs": ("runs", _json_sql({"state": "state"}, {}), "execution-runs"),
            "nodes": ("nod", _json_sql({"node_id": "node_id", "status": "status"}, {"work_total": "work_total"}), "execution-nodes"),
            "work": ("wrk", _json_sql({"node_id": "node_id", "partition_key": "partition_key", "state": "state"}, {}), "execution-work"),
            "heads": ("heads", _json_sql({"node_id": "node_id", "partition_key": "partition_key"}, {"version": "version"}), "execution-heads"),
        },
        "run_id",
    )
)
def f11_execution_fingerprint(spark, d):
    runs, nodes, work, _ = _ops(spark, d)
    return fingerprint.execution_fingerprint(runs, nodes, work, v.ops_heads(spark, d))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    s, g = _sides(spark, d)
    return repair.generate_repairs(reconcile.reconcile(s, g), s, g, "state-1")


@query(
    _parts_sql(
        f"{FILES}, told AS (SELECT * FROM iss WHERE kind IS NOT NULL)",
        {
            "manifests": ("man", _json_sql({c: c for c in ("artifact_id", "relative_path", "sha256")}, {"byte_size": "byte_size"}), "manifests"),
            "files": ("fil", _json_sql({c: c for c in ("relative_path", "sha256")}, {"byte_size": "byte_size"}), "files"),
            "issues": ("told", _json_sql({c: c for c in ("kind", "relative_path", "artifact_id", "entry_sha256")}, {}), "issues"),
        },
    )
)
def f13_inventory_digest(spark, d):
    m, f = v.ops_manifests(spark, d), v.ops_files(spark, d)
    return fingerprint.inventory_digest(m, f, artifacts.artifact_issues(m, f))


# --- repair

_ACT = f"""{INV}, act AS (SELECT o.sku, o.classification, CASE WHEN classification = 'missing_from_target' THEN 'create_target' ELSE 'update_target' END AS kind FROM outcome o WHERE classification IN ('missing_from_target', 'field_mismatch')),
eff_r AS (SELECT sku, {_EFFECT} AS e FROM ref), eff_t AS (SELECT sku, {_EFFECT} AS e FROM tgt)"""


@query(f"{_ACT} SELECT act.sku AS canonical_key, kind, CASE WHEN kind = 'update_target' THEN sha256(eff_t.e) END AS before_sha256, sha256(eff_r.e) AS after_sha256 FROM act JOIN eff_r USING (sku) LEFT JOIN eff_t USING (sku)")
def x01_generate_repairs(spark, d):
    return _actions(spark, d).select("canonical_key", "kind", "before_sha256", "after_sha256")


_PLAN = """concat('{"after_sha256":"', sha256(eff_r.e), '","before_sha256":', CASE WHEN kind = 'update_target' THEN concat('"', sha256(eff_t.e), '"') ELSE 'null' END, ',"canonical_key":"', act.sku, '","kind":"', kind, '"}')"""


@query(fingerprint_sql(f"{_ACT}, x AS (SELECT 'rpl_main' AS repair_plan_id, {_PLAN} AS e FROM act JOIN eff_r USING (sku) LEFT JOIN eff_t USING (sku))", "x", "e", "repair-plan", "repair_plan_id"))
def f12_plan_content_fingerprint(spark, d):
    return fingerprint.plan_content_fingerprint(_actions(spark, d))


@query(
    f"{_ACT} SELECT sku AS canonical_key, 'kind' AS rule FROM act WHERE sku LIKE '%3' UNION ALL SELECT sku, 'create_with_before' FROM act WHERE kind = 'create_target' AND sku LIKE '%1' UNION ALL SELECT sku, 'update_without_before' FROM act WHERE kind = 'update_target' AND sku LIKE '%5' "
    "UNION ALL SELECT sku, 'update_without_change' FROM act WHERE kind = 'update_target' AND sku LIKE '%7' UNION ALL SELECT sku, 'after_missing' FROM act WHERE kind = 'create_target' AND sku LIKE '%7'"
)
def x02_check_actions(spark, d):
    """Actions with planted faults of each kind, told by the last digit of their key."""
    ends = lambda n: F.col("canonical_key").endswith(n)
    a = _actions(spark, d).withColumn("kind", F.when(ends("3"), "delete").otherwise(F.col("kind")))
    a = a.withColumn("before_sha256", F.when(ends("5"), F.lit(None)).when(ends("1"), "x").otherwise(F.col("before_sha256"))).withColumn("after_sha256", F.when(ends("7"), F.col("before_sha256")).otherwise(F.col("after_sha256")))
    return repair.check_actions(a).select("canonical_key", "rule")


@query(f"{_ACT} SELECT 'rpl_main' AS repair_plan_id, 'too_many_actions' AS rule, CAST(count(*) AS VARCHAR) AS detail FROM act HAVING count(*) > 100")
def x03_plan_uniqueness(spark, d):
    return repair.check_plan_uniqueness(_actions(spark, d), limit=100)


@query(f"{_ACT} SELECT sku AS canonical_key, 'other_action' AS rule FROM act WHERE kind = 'create_target'")
def x04_against_conflicts(spark, d):
    s, g = _sides(spark, d)
    o = reconcile.reconcile(s, g)
    a = repair.generate_repairs(o, s, g, "state-1")
    c = reconcile.conflicts(o, s, g).withColumn("suggested_action", F.when(F.col("classification") == "missing_from_target", "none").otherwise(F.col("suggested_action")))
    return repair.check_against_conflicts(a, c).select("canonical_key", "rule")


def _plans(spark: SparkSession, d: str) -> DataFrame:
    """A plan for each customer's orders, of which every fifth has a stale fingerprint."""
    c = v.table(spark, d, "customer")
    return c.selectExpr("concat('rpl_', c_custkey) as repair_plan_id", "concat('run_', c_custkey % 7) as run_id", "case when c_custkey % 5 = 0 then 'old' else 'now' end as state_fingerprint", "concat('content-', c_custkey % 100) as content_fingerprint", "c_custkey")


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    c = v.table(spark, d, "customer").selectExpr("c_custkey % 7 as r").filter("r <> 6").distinct()
    return c.selectExpr("concat('run_', r) as run_id", "'now' as fingerprint", "case when r = 5 then 'failed' else 'succeeded' end as run_state")


@query("SELECT concat('rpl_', c_custkey) AS repair_plan_id, CASE WHEN c_custkey % 7 = 6 THEN 'no_state' WHEN c_custkey % 7 = 5 THEN 'run_state' ELSE 'fingerprint' END AS reason FROM customer WHERE c_custkey % 7 IN (5, 6) OR c_custkey % 5 = 0")
def x05_stale_plans(spark, d):
    return repair.stale_plans(_plans(spark, d), _summaries(spark, d)).select("repair_plan_id", "reason")


def _plan_actions(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return o.selectExpr("concat('rac_', o_orderkey) as repair_action_id", "concat('rpl_', o_custkey) as repair_plan_id", "concat('cnf_', o_orderkey % 500) as conflict_id", "concat('SKU-', o_orderkey) as canonical_key", "case when o_orderkey % 3 = 0 then 'create_target' else 'update_target' end as kind",
                        "case o_orderstatus when 'F' then 'applied' when 'O' then 'proposed' else 'failed' end as status", "sha2(cast(o_orderkey as string), 256) as before_sha256", "sha2(cast(o_orderkey + 1 as string), 256) as after_sha256", "concat('key-', o_orderkey) as external_idempotency_key")


def _plan_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The conflicts that the orders' actions name."""
    c = v.table(spark, d, "orders").selectExpr("o_orderkey % 500 as c").distinct()
    return c.selectExpr("concat('cnf_', c) as conflict_id", "case when c % 3 = 0 then 'missing_from_target' else 'field_mismatch' end as classification")


def _approvals(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d).filter("c_custkey % 2 = 0").selectExpr("repair_plan_id", "'now' as state_fingerprint", "concat('person ', c_custkey % 9) as approver", "c_custkey as approved_at")


@query("SELECT concat('rac_', o_orderkey) AS repair_action_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0")
def x06_approved_actions(spark, d):
    return repair.approved_actions(_plan_actions(spark, d), _plans(spark, d), _approvals(spark, d)).select("repair_action_id")


def _ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "external_idempotency_key string, repair_action_id string, status string, found_sha256 string, after_sha256 string")


@query(f"{_ACT}, new_t AS (SELECT sku, name, quantity, units FROM tgt WHERE sku NOT IN (SELECT sku FROM act) UNION ALL SELECT sku, name, quantity, units FROM ref WHERE sku IN (SELECT sku FROM act)) SELECT * FROM new_t")
def x07_apply_repairs(spark, d):
    g = v.inv_target(spark, d)
    new, _ = repair.apply_repairs(g, _actions(spark, d), _ledger(spark))
    return new.select("sku", "name", "quantity", F.col("unit_price_minor_units").alias("units"))


@query(f"{_ACT} SELECT 'applied' AS status, count(*) AS n FROM act GROUP BY 1")
def x08_idempotent_replay(spark, d):
    """The ledger of one run given to a second: no action is left, so the counts are those of the first."""
    g, a = v.inv_target(spark, d), _actions(spark, d)
    new, ledger = repair.apply_repairs(g, a, _ledger(spark))
    _, again = repair.apply_repairs(new, a, ledger)
    return ledger.unionByName(again).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT concat('rpl_', c_custkey) AS repair_plan_id, count(o_orderkey) AS n_actions, CASE WHEN count(o_orderkey) = 0 OR bool_and(o_orderstatus = 'O') THEN 'proposed' WHEN bool_or(o_orderstatus NOT IN ('F', 'O')) THEN 'failed' WHEN bool_and(o_orderstatus = 'F') THEN 'applied' ELSE 'applying' END AS derived_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def x09_plan_status(spark, d):
    return repair.plan_status(_plans(spark, d), _plan_actions(spark, d))


@query("SELECT concat('rpl_', c_custkey) AS repair_plan_id, CASE WHEN c_custkey % 2 = 0 THEN concat('person ', c_custkey % 9) END AS approver, count(o_orderkey) AS n_actions, min('SKU-' || o_orderkey) AS first_key, count(*) FILTER (o_orderkey % 500 % 3 = 0) AS n_missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def x10_plan_details(spark, d):
    p = repair.plan_details(_plans(spark, d), _approvals(spark, d), _plan_actions(spark, d), _plan_conflicts(spark, d))
    listed = F.when(F.col("actions").isNotNull(), F.size("actions")).otherwise(0)
    missing = F.coalesce(F.size(F.filter("actions", lambda a: a["classification"] == "missing_from_target")), F.lit(0))
    missing = F.when(F.col("actions").isNotNull(), missing).otherwise(0)
    return p.groupBy("repair_plan_id", "approver").agg(F.sum(listed).alias("n_actions"), F.min(F.try_element_at("actions", F.lit(1))["canonical_key"]).alias("first_key"), F.sum(missing).alias("n_missing"))


@query("SELECT concat('run_', c_custkey % 7) AS run_id, concat('content-', c_custkey % 100) AS content_fingerprint, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def x11_duplicate_plan_content(spark, d):
    return repair.duplicate_plan_content(_plans(spark, d))


@query(f"""{_ACT} SELECT 'repairable' AS "check", count(*) AS n FROM act WHERE sku NOT LIKE '%1' UNION ALL SELECT 'fingerprint', 1""")
def x12_verify_target(spark, d):
    """A target on which only the actions of some keys were applied, against the fingerprint of the whole repair."""
    s, g = _sides(spark, d)
    a = _actions(spark, d)
    part, _ = repair.apply_repairs(g, a.filter("canonical_key like '%1'"), _ledger(spark))
    whole, _ = repair.apply_repairs(g, a, _ledger(spark))
    return repair.verify_target(s, part, fingerprint.inventory_fingerprint(whole)).groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'create_target' ELSE 'update_target' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'proposed' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def x13_action_counts(spark, d):
    return repair.action_counts(_plan_actions(spark, d))


@query(f"{INV} SELECT sku AS canonical_key FROM flags WHERE one AND (name_mismatch OR quantity_mismatch OR unit_price_mismatch OR updated_at_mismatch OR attributes_mismatch) AND (name_mismatch OR unit_price_mismatch OR updated_at_mismatch OR attributes_mismatch OR NOT quantity_mismatch)")
def x14_mismatch_evidence(spark, d):
    a = _actions(spark, d).withColumn("mismatches", F.array(F.lit("quantity")))
    return repair.check_mismatch_evidence(a).select("canonical_key")


@query("SELECT concat('rpl_', c_custkey) AS repair_plan_id, 'content' AS rule FROM customer UNION ALL SELECT concat('rpl_', c_custkey), 'approval' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0 UNION ALL SELECT DISTINCT concat('rpl_', o_custkey), 'repeated_conflict_id' FROM (SELECT o_custkey, o_orderkey % 500 FROM orders GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT DISTINCT concat('rpl_', o_custkey), 'unknown_plan' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def x15_check_plans(spark, d):
    return repair.check_plans(_plans(spark, d), _approvals(spark, d), _plan_actions(spark, d))


# --- run statistics

_Q = ", ".join(f"quantile_disc(duration_microseconds, {p / 100}) AS p{p}_microseconds" for p in runstats.PERCENTS)


@query(f"{OPS} SELECT run_id, work_item_id, attempt_number, row_number() OVER (PARTITION BY run_id, node_id ORDER BY duration_microseconds, work_item_id, attempt_number) AS rank, count(*) OVER (PARTITION BY run_id, node_id) AS of FROM att")
def t01_ranked_attempts(spark, d):
    r = runstats.ranked_attempts(v.ops_attempts(spark, d), "run_id", "node_id")
    return r.select("run_id", "work_item_id", "attempt_number", F.col("rank").cast("long").alias("rank"), "of")


@query(f"{OPS} SELECT run_id, node_id, count(*) AS attempts, {_Q} FROM att GROUP BY 1, 2")
def t02_node_latency(spark, d):
    return runstats.node_latency(v.ops_attempts(spark, d))


@query(f"{OPS} SELECT run_id, count(*) AS attempts, {_Q} FROM att GROUP BY 1")
def t02_latency_by_rank(spark, d):
    return runstats.latency_by_rank(v.ops_attempts(spark, d), "run_id")


@query(f"{OPS} SELECT run_id, node_id, n.work_total, n.status, count(a.node_id) AS attempts, {_Q.replace('duration_microseconds,', 'a.duration_microseconds,')} FROM nod n LEFT JOIN att a USING (run_id, node_id) GROUP BY 1, 2, 3, 4")
def t03_node_statistics(spark, d):
    s = runstats.node_statistics(v.ops_nodes(spark, d), v.ops_attempts(spark, d))
    return s.select("run_id", "node_id", "work_total", "status", "attempts", *[f"p{p}_microseconds" for p in runstats.PERCENTS])


@query(f"{OPS} SELECT r.run_id, r.state, n.work_total, n.work_failed, n.retry_count, n.duration_microseconds, a.attempts, p50_microseconds, p95_microseconds, p99_microseconds FROM runs r JOIN (SELECT run_id, sum(work_total)::BIGINT AS work_total, sum(work_failed)::BIGINT AS work_failed, sum(retry_count)::BIGINT AS retry_count, sum(duration_microseconds)::BIGINT AS duration_microseconds FROM nod GROUP BY 1) n USING (run_id) JOIN (SELECT run_id, count(*) AS attempts, {_Q} FROM att GROUP BY 1) a USING (run_id)")
def t05_run_summary(spark, d):
    runs, nodes, _, attempts = _ops(spark, d)
    s = runstats.run_summary(runs, nodes, attempts)
    return s.select("run_id", "state", "work_total", "work_failed", "retry_count", "duration_microseconds", "attempts", *[f"p{p}_microseconds" for p in runstats.PERCENTS])


@query(f"{OPS} SELECT run_id, node_id, attempts FROM derived WHERE run_id = 'run_1' AND node_id > 'nod_2' ORDER BY node_id LIMIT 4")
def t06_statistics_page(spark, d):
    s = runstats.node_statistics(v.ops_nodes(spark, d), v.ops_attempts(spark, d)).filter("run_id = 'run_1'")
    return paging.page_frame(s, ["node_id"], ("nod_2",), 3).select("run_id", "node_id", "attempts")


@query(f"{OPS} SELECT run_id, node_id, work_total, work_pending, work_running, work_succeeded, work_quarantined, work_failed, work_cancelled, attempts, retry_count, CAST(duration_microseconds AS BIGINT) AS duration_microseconds FROM derived")
def t07_derive_node_aggregates(spark, d):
    a = runstats.derive_node_aggregates(v.ops_work(spark, d), v.ops_attempts(spark, d))
    return a.select("run_id", "node_id", "work_total", *[f"work_{b}" for b in runstats.WORK_BUCKETS], "attempts", "retry_count", "duration_microseconds")


@query(f"{OPS} SELECT run_id, node_id, CASE WHEN work_pending + work_running > 0 THEN 'running' WHEN work_failed > 0 THEN 'failed' WHEN work_cancelled = work_total THEN 'cancelled' WHEN work_quarantined + work_cancelled > 0 THEN 'partially_succeeded' ELSE 'succeeded' END AS derived_status FROM derived")
def t09_node_status(spark, d):
    return runstats.node_status(runstats.derive_node_aggregates(v.ops_work(spark, d), v.ops_attempts(spark, d))).select("run_id", "node_id", "derived_status")


@query(f"{OPS} SELECT run_id, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_and(state = 'succeeded') THEN 'succeeded' ELSE 'partially_succeeded' END AS outcome FROM wrk GROUP BY 1")
def t10_run_outcome(spark, d):
    return runstats.run_outcome(v.ops_work(spark, d))


@query(f"{OPS}, act AS (SELECT run_id, node_id, min(active_attempt_started_at) AS active_at FROM wrk GROUP BY 1, 2) SELECT run_id, node_id, least(min(started_at), min(active_at)) AS started_us, max(finished_at) AS finished_us FROM att JOIN act USING (run_id, node_id) GROUP BY 1, 2")
def t12_node_times(spark, d):
    a = runstats.derive_node_aggregates(v.ops_work(spark, d), v.ops_attempts(spark, d))
    return a.select("run_id", "node_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"))


@query(f"{OPS} SELECT n.run_id, n.node_id, 'work_total' AS \"column\", n.work_total AS stored, d.work_total AS derived FROM nod n JOIN derived d USING (run_id, node_id) WHERE n.work_total <> d.work_total")
def t13_aggregate_drift(spark, d):
    _, nodes, work, attempts = _ops(spark, d)
    return runstats.aggregate_drift(nodes, work, attempts)


@query(f"{OPS} SELECT run_id, node_id, 'buckets' AS rule FROM nod WHERE node_id IN ('nod_0', 'nod_5')")
def t14_check_metrics(spark, d):
    return runstats.check_metrics(runstats.node_statistics(v.ops_nodes(spark, d), v.ops_attempts(spark, d)))


@query(f"{OPS} SELECT run_id, node_id, CAST(attempts * 20 AS BIGINT) AS records_read, CAST(duration_microseconds * 2 AS BIGINT) AS duration_microseconds FROM derived")
def t15_accumulate_metrics(spark, d):
    n = v.ops_nodes(spark, d)
    return runstats.accumulate_metrics(n, n).select("run_id", "node_id", "records_read", "duration_microseconds")


@query(f"{OPS} SELECT n.run_id, 'work_total' AS \"column\", CAST(sum(n.work_total) AS BIGINT) AS stored, CAST(sum(d.work_total) AS BIGINT) AS derived FROM nod n JOIN derived d USING (run_id, node_id) GROUP BY 1 HAVING sum(n.work_total) <> sum(d.work_total)")
def t16_check_summary(spark, d):
    return runstats.check_summary(*_ops(spark, d))


@query("SELECT 'attempts' AS \"table\", CAST(1 AS BIGINT) AS expected, count(*) AS found FROM events HAVING count(*) <> 1")
def t17_source_counts(spark, d):
    return runstats.check_source_counts({"attempts": 1}, attempts=v.ops_attempts(spark, d))


_COUNTS = {c: c for c in runstats.COMPARED} | {"records_read": "attempts * 10", "records_written": "attempts * 9", "records_quarantined": "attempts"}
_FACTS = " UNION ALL ".join(
    ["SELECT run_id, NULL AS node_id, NULL AS partition_key, 'plan' AS what, sha256(run_id) AS value FROM runs"]
    + [f"SELECT run_id, node_id, NULL, '{c}', CAST({e} AS VARCHAR) FROM nod" for c, e in _COUNTS.items()]
    + ["SELECT run_id, node_id, partition_key, 'state', state FROM wrk", "SELECT run_id, node_id, partition_key, 'checkpoint', CAST(version AS VARCHAR) FROM heads"]
    + ["SELECT concat('run_', o_custkey % 3), concat('nod_', o_custkey % 8), concat('partition-', lpad(CAST(o_custkey AS VARCHAR), 8, '0')), 'artifacts', concat(count(*), ':', sum(CAST(concat('0x', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT))) FROM orders WHERE o_orderkey % 41 <> 0 GROUP BY o_custkey"]
)
_IN = [f"max(CASE WHEN run_id = 'run_{k}' THEN value END)" for k in (0, 1)]


@query(f"{OPS}, f AS ({_FACTS}) SELECT node_id, partition_key, what, {_IN[0]} AS in_a, {_IN[1]} AS in_b FROM f WHERE run_id IN ('run_0', 'run_1') GROUP BY 1, 2, 3 HAVING {_IN[0]} IS DISTINCT FROM {_IN[1]}")
def t18_compare_runs(spark, d):
    runs, nodes, work, _ = _ops(spark, d)
    return runstats.compare_runs(runs, nodes, work, v.ops_heads(spark, d), v.ops_manifests(spark, d), "run_0", "run_1")


@query(f"{OPS} SELECT state, count(*) AS n FROM runs GROUP BY 1")
def t19_run_state_counts(spark, d):
    return runstats.run_state_counts(v.ops_runs(spark, d))


# --- history


@query(f"{EVS}, g AS (SELECT user_id, count(*) AS n, min(sequence_number) AS low, max(sequence_number) AS high, max(of_n) AS f FROM evs GROUP BY 1) SELECT concat('run_', user_id) AS run_id, n, low, high, f AS frontier FROM g WHERE NOT (low = 1 AND high = f AND n = f)")
def h01_contiguous(spark, d):
    return history.check_contiguous(v.ops_events(spark, d), ["run_id"], "sequence_number", v.ops_frontier(spark, d), "last")


@query(f"{EVS}, l AS (SELECT user_id, sequence_number AS s, coalesce(lag(sequence_number) OVER (PARTITION BY user_id ORDER BY sequence_number), 0) AS b FROM evs) SELECT concat('run_', user_id) AS run_id, b + 1 AS gap_from, s - 1 AS gap_to FROM l WHERE s > b + 1")
def h02_sequence_gaps(spark, d):
    return history.sequence_gaps(v.ops_events(spark, d), ["run_id"], "sequence_number")


@query(f"{EVS}, b AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'new' WHEN event_id % 7 = 0 THEN 'conflict' ELSE 'replay' END AS disposition FROM events WHERE event_id % 3 = 0) SELECT disposition, count(*) AS n FROM b GROUP BY 1")
def h03_replay_compare(spark, d):
    log = v.ops_events(spark, d).select("event_id", "kind")
    batch = v.table(spark, d, "events").filter("event_id % 3 = 0").selectExpr("event_id", "case when event_id % 7 = 0 then 'other' else event_type end as kind")
    return history.replay_compare(log, batch, ["event_id"]).groupBy("disposition").agg(F.count("*").alias("n"))


@query(f"{EVS} SELECT concat('run_', user_id) AS run_id, sequence_number, CASE WHEN event_id % 97 = 0 THEN 'surplus' WHEN event_id % 5 = 0 THEN 'missing' ELSE 'conflict' END AS disposition FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_number, count(*) OVER (PARTITION BY user_id) AS of_n FROM events) WHERE sequence_number BETWEEN 2 AND of_n - 1 AND user_id % 2 = 0 AND (event_id % 97 = 0 AND event_id % 5 <> 0 OR event_id % 97 <> 0 AND event_id % 5 = 0 OR event_id % 97 <> 0 AND event_id % 5 <> 0 AND event_id % 7 = 0)")
def h03_range_replay(spark, d):
    """Every second run is replayed from its second event to its last but one: without every fifth event, with every seventh changed and with the lost ones."""
    e = v.table(spark, d, "events").withColumn("t", v.micros("ts"))
    e = e.selectExpr("concat('run_', user_id) as run_id", "row_number() over (partition by user_id order by t, event_id) as sequence_number", "count(*) over (partition by user_id) as of_n", "event_type as kind", "event_id", "user_id").filter("user_id % 2 = 0")
    batch = e.filter("event_id % 5 <> 0").selectExpr("run_id", "cast(sequence_number as bigint) as sequence_number", "case when event_id % 7 = 0 and event_id % 97 <> 0 then 'other' else kind end as kind", "event_id")
    ranges = e.groupBy("run_id").agg((F.max("of_n") - 1).alias("last")).select("run_id", F.lit(2).alias("first"), "last")
    log = v.ops_events(spark, d).select("run_id", "sequence_number", "kind", "event_id")
    return history.range_replay(log, batch, ["run_id"], "sequence_number", ranges)


@query(f"{EVS} SELECT concat('run_', user_id) AS run_id, sequence_number, concat('run_', user_id + 1) AS subject_id, 'run_subject' AS rule FROM evs WHERE event_id % 2 = 0 AND event_id % 53 = 0")
def h04_event_subjects(spark, d):
    work = v.table(spark, d, "events").selectExpr("concat('run_', user_id) as run_id", "concat('wrk_', user_id) as work_item_id").distinct()
    return history.check_event_subjects(v.ops_events(spark, d), work)


@query(f"""{EVS} SELECT 'manifest_before_run' AS rule, concat('art_', o_orderkey) AS id FROM orders WHERE o_orderkey % 41 <> 0 AND epoch_us(o_orderdate) < epoch_us(TIMESTAMP '2000-01-01')
UNION ALL SELECT 'event_before_run', concat('run_', user_id, '/', sequence_number) FROM evs WHERE event_id % 101 = 0
UNION ALL SELECT DISTINCT 'run_times', concat('run_', user_id) FROM evs WHERE event_id % 101 = 0
UNION ALL SELECT 'artifact_after_checkpoint', concat('run_', o_custkey % 3, '/n/p/', o_orderkey) FROM orders WHERE o_orderkey % 41 <> 0 AND o_orderkey % 37 = 0""")
def h05_chronology(spark, d):
    """All four rules over whole tables: every 101st event is moved before its run, which then starts early, and every 37th checkpoint before its artifact."""
    o = v.table(spark, d, "orders").filter("o_orderkey % 41 <> 0")
    m = o.select(F.expr("concat('art_', o_orderkey)").alias("artifact_id"), F.expr("concat('run_', o_custkey % 3)").alias("run_id"), F.timestamp_micros(v.micros("o_orderdate")).alias("created_at"))
    checkpoints = m.select("run_id", F.lit("n").alias("node_id"), F.lit("p").alias("partition_key"), F.substring("artifact_id", 5, 20).cast("long").alias("version"), "artifact_id", F.timestamp_micros(F.unix_micros("created_at") + F.when(F.col("version") % 37 == 0, -1).otherwise(1)).alias("created_at"))
    events, moment = v.ops_events(spark, d), F.timestamp_micros(F.lit(946_684_800_000_000))
    events = events.withColumn("occurred_at", F.when(F.col("event_id") % 101 == 0, F.timestamp_micros(F.lit(900_000_000_000_000))).otherwise(F.col("occurred_at")))
    times = events.groupBy("run_id").agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))
    runs = m.select("run_id").distinct().join(times, "run_id", "full_outer")
    runs = runs.select("run_id", moment.alias("created_at"), F.coalesce("first", moment).alias("started_at"), F.coalesce("last", moment).alias("finished_at"))
    return history.check_chronology(runs, events, checkpoints, m)


@query("SELECT concat('run_', o_custkey) AS run_id, max(o_orderkey) AS version FROM orders GROUP BY o_custkey")
def h06_latest_checkpoints(spark, d):
    c = v.table(spark, d, "orders").select(F.expr("concat('run_', o_custkey)").alias("run_id"), F.lit("n").alias("node_id"), F.lit("p").alias("partition_key"), F.col("o_orderkey").alias("version"), "o_orderdate")
    return history.latest_checkpoints(c).select("run_id", "version")


@query(f"{OPS}, x AS (SELECT w.*, h.version FROM wrk2 w LEFT JOIN heads h USING (run_id, node_id, partition_key)) SELECT work_item_id, 'missing_head' AS rule FROM x WHERE version IS NULL UNION ALL SELECT work_item_id, 'version' FROM x WHERE version <> expected_checkpoint_version UNION ALL SELECT work_item_id, 'success_without_checkpoint' FROM x WHERE state = 'succeeded' AND version < 1")
def h07_checkpoint_frontier(spark, d):
    return history.check_checkpoint_frontier(v.ops_work(spark, d), v.ops_heads(spark, d))


@query("SELECT o_orderkey AS version, CASE WHEN o_orderkey % 41 = 0 THEN 'unknown_artifact' ELSE 'other_partition' END AS rule FROM orders WHERE o_orderkey % 41 = 0 OR o_orderkey % 6 = 0")
def h08_checkpoint_artifacts(spark, d):
    c = v.table(spark, d, "orders").selectExpr("concat('run_', o_custkey % 3) as run_id", "concat('nod_', o_custkey % 8) as node_id", "case when o_orderkey % 6 = 0 then 'other' else concat('partition-', lpad(o_custkey, 8, '0')) end as partition_key", "o_orderkey as version", "concat('art_', o_orderkey) as artifact_id")
    return history.check_checkpoint_artifacts(c, v.ops_manifests(spark, d)).select("version", "rule")


_LEGAL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b" for a, to in WORK_TRANSITIONS.items() for b in to)


@query(f"WITH {v.SQL_EVENTS}, s AS (SELECT user_id, sequence_number, (['pending', 'leased', 'running', 'retry_wait', 'succeeded'])[event_id % 5 + 1] AS st FROM evs), m AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY sequence_number) AS f FROM s), legal AS ({_LEGAL}) SELECT concat('run_', user_id) AS run_id, sequence_number, f AS from_state, st AS to_state FROM m LEFT JOIN legal ON f = a AND st = b WHERE f IS NOT NULL AND a IS NULL")
def h09_illegal_transitions(spark, d):
    h = v.ops_events(spark, d).withColumn("state", F.expr("element_at(array('pending', 'leased', 'running', 'retry_wait', 'succeeded'), cast(event_id % 5 as int) + 1)"))
    return history.illegal_transitions(h, ["run_id"], "sequence_number", WORK_TRANSITIONS)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'deleted' WHEN o_orderkey % 11 = 0 THEN 'immutable' ELSE 'monotonic' END AS rule FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'monotonic' FROM orders WHERE false UNION ALL SELECT o_orderkey, 'terminal' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0 AND o_orderstatus = 'F'")
def h10_snapshot_change(spark, d):
    before = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderkey").alias("version"))
    after = before.filter("o_orderkey % 13 <> 0").withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))
    return history.check_snapshot_change(before, after, ["o_orderkey"], ["o_custkey"], ["version"], "o_orderstatus", ["F"]).select("o_orderkey", "rule")


@query("SELECT 'lineitem' AS \"table\", 'l_orderkey' AS columns, CAST(l_orderkey AS VARCHAR) AS value FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)) UNION ALL SELECT 'orders', 'o_custkey', CAST(o_custkey AS VARCHAR) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 50 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer))")
def h11_foreign_keys(spark, d):
    tables = {n: v.table(spark, d, n) for n in ("lineitem", "orders", "customer")} | {"orders": v.table(spark, d, "orders").filter("o_orderkey % 50 <> 0")}
    return history.check_foreign_keys(tables, [("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), ("orders", ("o_custkey",), "customer", ("c_custkey",))])


@query("SELECT 'lineitem' AS \"table\", 'l_orderkey,l_linenumber' AS columns, concat(l_orderkey, '/', l_linenumber) AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def h12_unique(spark, d):
    tables = {n: v.table(spark, d, n) for n in ("lineitem", "orders")}
    return history.check_unique(tables, [("lineitem", ("l_orderkey", "l_linenumber")), ("orders", ("o_orderkey",))])


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'quantity' AS rule FROM lineitem WHERE NOT coalesce(l_quantity BETWEEN 1 AND 40, false) UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'flag' FROM lineitem WHERE NOT coalesce(l_returnflag IN ('A', 'N'), false)")
def h13_row_rules(spark, d):
    li = v.table(spark, d, "lineitem")
    return history.broken_rules(li, ["l_orderkey", "l_linenumber", "l_partkey"], {"quantity": F.col("l_quantity").between(1, 40), "flag": F.col("l_returnflag").isin("A", "N")})


def _faulty_model(spark, d):
    """The history tables with planted faults: of rows (negative, unknown and missing values, wrong digests and ids, JSON of another kind), of unique keys and of foreign keys."""
    runs, nodes, work, attempts = _ops(spark, d)
    u = F.regexp_replace("work_item_id", "wrk_", "").cast("long")
    pad = lambda c, p: F.concat(F.lit(p), F.lpad(F.regexp_replace(c, "[a-z]+_", ""), 6, "0"))
    work = work.withColumn("row_version", F.when(u % 47 == 0, 0).otherwise(F.col("row_version"))).withColumn("input_reference_json", F.when(u % 41 == 0, F.lit("[1]")).when(u % 43 == 0, F.lit("{")).when(u % 2 == 0, F.lit('{"a": 1}')))
    attempts = attempts.withColumn("duration_microseconds", F.when((u % 53 == 0) & (F.col("attempt_number") == 1), -1).otherwise(F.col("duration_microseconds"))).withColumn("outcome", F.when((u % 59 == 0) & (F.col("attempt_number") == 1), "lost").otherwise(F.col("outcome")))
    twice = work.filter(u % 31 == 0).withColumn("work_item_id", F.concat("work_item_id", F.lit("-b")))
    heads = v.ops_heads(spark, d).withColumn("partition_key", F.when(F.substring("partition_key", 11, 8).cast("long") % 29 == 0, F.concat(F.lit("x"), F.col("partition_key"))).otherwise(F.col("partition_key")))
    named = lambda df: df.withColumn("work_item_id", F.when(F.col("work_item_id").endswith("-b"), F.concat(pad(F.regexp_replace("work_item_id", "-b", ""), "wrk_"), F.lit("-b"))).otherwise(pad("work_item_id", "wrk_")))
    run = lambda df: df.withColumn("run_id", pad("run_id", "run_"))
    node = lambda df: df.withColumn("node_id", pad("node_id", "nod_"))
    runs = run(runs).withColumn("plan_fingerprint", F.when(F.col("run_id") == "run_000001", F.upper("plan_fingerprint")).otherwise(F.col("plan_fingerprint")))
    return {"runs": runs.filter("run_id <> 'run_000002'"), "run_nodes": run(node(nodes)), "work_items": run(node(named(work.unionByName(twice)))), "work_attempts": named(attempts.filter(u % 61 != 0).unionByName(attempts.filter((u % 67 == 0) & (u % 61 != 0) & (F.col("attempt_number") == 1)))), "checkpoint_heads": run(node(heads))}


_MODEL = f"""{OPS}, m AS (SELECT u, run_id, node_id, partition_key, state, concat('wrk_', lpad(CAST(u AS VARCHAR), 6, '0')) AS id, concat('run_', lpad(substr(run_id, 5), 6, '0')) AS r, concat('nod_', lpad(substr(node_id, 5), 6, '0')) AS nd,
  completed_attempt_count, active_attempt_number FROM wrk),
w AS (SELECT * FROM m UNION ALL SELECT u, run_id, node_id, partition_key, state, concat(id, '-b'), r, nd, completed_attempt_count, active_attempt_number FROM m WHERE u % 31 = 0),
a0 AS (SELECT concat('wrk_', lpad(CAST(u AS VARCHAR), 6, '0')) AS id, u, attempt_number, outcome, failure_class FROM att WHERE u % 61 <> 0),
a AS (SELECT * FROM a0 UNION ALL SELECT * FROM a0 WHERE u % 67 = 0 AND attempt_number = 1),
hd AS (SELECT concat('run_', lpad(substr(run_id, 5), 6, '0')) AS r, concat('nod_', lpad(substr(node_id, 5), 6, '0')) AS nd, concat('x', partition_key) AS p FROM heads WHERE CAST(substr(partition_key, 11, 8) AS BIGINT) % 29 = 0)"""


@query(f"""{_MODEL} SELECT 'run_nodes' AS "table", 'foreign:run_id' AS rule, 'run_000002' AS id FROM nod WHERE run_id = 'run_2' GROUP BY 1, 2, 3
UNION ALL SELECT 'checkpoint_heads', 'foreign:run_id,node_id,partition_key', concat_ws('/', r, nd, p) FROM hd""")
def h11_model_foreign_keys(spark, d):
    """All declared keys between the tables, with a run taken away and heads of unknown partitions."""
    return constraints.check_model(_faulty_model(spark, d)).filter("rule like 'foreign:%'").select("table", "rule", "id")


@query(f"""{_MODEL} SELECT 'work_items' AS "table", 'unique:run_id,node_id,partition_key' AS rule, concat_ws('/', r, nd, partition_key) AS id FROM w GROUP BY r, nd, partition_key HAVING count(*) > 1
UNION ALL SELECT 'work_attempts', 'unique:work_item_id,attempt_number', concat_ws('/', id, attempt_number) FROM a GROUP BY id, attempt_number HAVING count(*) > 1""")
def h12_model_unique(spark, d):
    """All declared unique keys, with work items of one partition and attempts that are there twice."""
    return constraints.check_model(_faulty_model(spark, d)).filter("rule like 'unique:%'").select("table", "rule", "id")


@query(f"""{_MODEL} SELECT 'work_items' AS "table", rule, id FROM w, (VALUES ('row_version_range'), ('input_reference_json_object'), ('active_attempt'), ('active_attempt_number_order'), ('retry_time')) AS x(rule)
WHERE rule = 'row_version_range' AND u % 47 = 0 OR rule = 'input_reference_json_object' AND (u % 41 = 0 OR u % 43 = 0) OR rule = 'active_attempt' AND state = 'running' AND u % 40 = 0 OR rule = 'active_attempt_number_order' AND active_attempt_number <> completed_attempt_count + 1 OR rule = 'retry_time' AND state = 'running' AND u % 17 = 0
UNION ALL SELECT 'work_attempts', rule, concat_ws('/', id, attempt_number) FROM a, (VALUES ('duration_microseconds_range'), ('outcome_values'), ('failure')) AS x(rule)
WHERE attempt_number = 1 AND (rule = 'duration_microseconds_range' AND u % 53 = 0 OR rule = 'outcome_values' AND u % 59 = 0 OR rule = 'failure' AND u % 59 = 0 AND failure_class IS NULL)
UNION ALL SELECT 'runs', 'plan_fingerprint_shape', 'run_000001' FROM runs WHERE run_id = 'run_1'
UNION ALL SELECT 'run_nodes', 'duration_microseconds_range', NULL FROM nod WHERE duration_microseconds < 0""")
def h13_model_rules(spark, d):
    """Every declared row rule over the history tables; planted are faults of ranges, values, digests, JSON and of what must go together."""
    return constraints.check_model(_faulty_model(spark, d)).filter("rule not like '%:%'").select("table", "rule", "id")


@query(f"{OPS} SELECT run_id, 'work_item' AS kind, work_item_id AS id, state FROM wrk WHERE state IN ('running', 'retry_wait') UNION ALL SELECT run_id, 'node', node_id, status FROM nod WHERE status = 'running'")
def h14_unfinished_work(spark, d):
    _, nodes, work, _ = _ops(spark, d)
    return history.unfinished_work(work, nodes)


@query(f"{EVS} SELECT concat('run_', user_id) AS run_id, (sequence_number - 1) // 10000 AS block, string_agg(kind, ',' ORDER BY sequence_number) AS kinds FROM evs GROUP BY user_id, (sequence_number - 1) // 10000")
def h16_event_trace(spark, d):
    return history.event_trace(v.ops_events(spark, d)).select("run_id", "block", F.array_join("kinds", ",").alias("kinds"))


@query(f"{OPS} SELECT work_item_id, attempt_number, 'duration' AS rule FROM att WHERE attempt_number % 19 = 0 UNION ALL SELECT work_item_id, attempt_number, 'lease_expired' FROM att WHERE outcome = 'lease_expired' AND attempt_number % 23 = 0")
def h17_check_attempts(spark, d):
    a = v.ops_attempts(spark, d)
    a = a.withColumn("duration_microseconds", F.col("duration_microseconds") + F.when(F.col("attempt_number") % 19 == 0, 1).otherwise(0)).withColumn("failure_class", F.when((F.col("outcome") == "lease_expired") & (F.col("attempt_number") % 23 == 0), "connection").otherwise(F.col("failure_class")))
    return history.check_attempts(a)


def _traces(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").withColumn("t", v.micros("ts")).selectExpr("concat('wrk_', user_id) as work_item_id", "cast(event_id div 500 as int) as attempt_number", "event_type as kind", "timestamp_micros(t) as occurred_at", "cast(user_id as string) as context")
    return history.check_attempt_traces(e, ("purchase", "error"), "view")


@query("""WITH g AS (SELECT user_id, event_id // 500 AS a, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type IN ('purchase', 'error')) AS e, count(*) FILTER (event_type NOT IN ('view', 'purchase', 'error')) AS o, min(ts) FILTER (event_type = 'view') AS t0, min(ts) FILTER (event_type IN ('purchase', 'error')) AS t1 FROM events GROUP BY 1, 2),
r AS (SELECT user_id, a, 'start' AS rule FROM g WHERE s <> 1 UNION ALL SELECT user_id, a, 'end' FROM g WHERE e > 1 UNION ALL SELECT user_id, a, 'kind' FROM g WHERE o > 0 UNION ALL SELECT user_id, a, 'order' FROM g WHERE t1 IS NOT NULL AND NOT coalesce(t1 >= t0, false))
SELECT concat('wrk_', user_id) AS work_item_id, CAST(a AS INTEGER) AS attempt_number, rule FROM r""")
def h18_attempt_traces(spark, d):
    return _traces(spark, d)


@query(f"{OPS}, l AS (SELECT work_item_id, max_by(outcome, attempt_number) AS last_outcome FROM att GROUP BY 1) SELECT work_item_id, state, last_outcome FROM wrk JOIN l USING (work_item_id) WHERE state = 'retry_wait' AND last_outcome NOT IN ('retry_scheduled', 'lease_expired')")
def h19_state_outcome(spark, d):
    return history.check_state_outcome(v.ops_work(spark, d), v.ops_attempts(spark, d))


@query(f"{OPS} SELECT run_id, node_id, 'timestamps' AS rule FROM nod WHERE status = 'running' AND node_id = 'nod_3'")
def h20_node_timestamps(spark, d):
    n = v.ops_nodes(spark, d)
    return history.check_node_timestamps(n.withColumn("started_at", F.when(~((F.col("status") == "running") & (F.col("node_id") == "nod_3")), F.col("started_at"))))


# --- idempotency, retries, recovery


@query(f"{IDEM}, q AS (SELECT r.*, row_number() OVER (PARTITION BY r.scope, r.idempotency_key, r.request_sha256 ORDER BY r.created_at) AS nth, i.request_sha256 AS stored, i.status, first_value(r.request_sha256) OVER (PARTITION BY r.scope, r.idempotency_key ORDER BY r.created_at, r.request_sha256) AS first_req FROM req r LEFT JOIN idem i ON r.scope = i.scope AND r.idempotency_key = i.idempotency_key) SELECT scope, idempotency_key, created_at, CASE WHEN request_sha256 <> coalesce(stored, first_req) THEN 'conflict' WHEN stored IS NULL AND nth = 1 THEN 'started' ELSE concat(coalesce(status, 'in_progress'), '_replay') END AS disposition FROM q")
def i01_idempotency_begin(spark, d):
    return recovery.idempotency_begin(v.ops_idem(spark, d), v.ops_requests(spark, d)).select("scope", "idempotency_key", "created_at", "disposition")


@query("SELECT o_orderkey, sha256(concat('{\"customer\":', o_custkey, ',\"status\":\"', o_orderstatus, '\"}')) AS digest FROM orders")
def i02_request_digest(spark, d):
    o = v.table(spark, d, "orders")
    return o.select("o_orderkey", recovery.request_digest(F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")))).alias("digest"))


@query(f"{IDEM} SELECT scope, idempotency_key, CASE WHEN status = 'in_progress' THEN 'completed' WHEN status = 'completed' AND ck % 4 <> 0 THEN 'replay' ELSE 'conflict' END AS verdict FROM idem")
def i03_idempotency_complete(spark, d):
    i = v.ops_idem(spark, d)
    k = F.col("idempotency_key").cast("long")
    r = i.select("scope", "idempotency_key", F.lit("completed").alias("status"), F.when(k % 4 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("idempotency_key", 256)).alias("result_sha256"))
    return recovery.idempotency_complete(i, r).select("scope", "idempotency_key", "verdict")


@query(f"{IDEM} SELECT created_at, scope, idempotency_key FROM idem WHERE status = 'in_progress' ORDER BY created_at, scope, idempotency_key LIMIT 101")
def i04_in_progress_page(spark, d):
    return paging.page_frame(v.ops_idem(spark, d).filter("status = 'in_progress'"), ["created_at", "scope", "idempotency_key"], None, 100).select("created_at", "scope", "idempotency_key")


@query(f"{IDEM} SELECT scope, idempotency_key, request_sha256 FROM idem UNION ALL SELECT scope, idempotency_key, min(request_sha256) FROM req WHERE ck % 3 <> 0 GROUP BY scope, idempotency_key")
def i05_insert_absent(spark, d):
    cols = ["scope", "idempotency_key", "request_sha256"]
    return recovery.insert_absent(v.ops_idem(spark, d).select(*cols), v.ops_requests(spark, d).select(*cols), cols[:2])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def i06_cas_update(spark, d):
    now = v.table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment", "1 as version")
    change = now.filter("c_custkey % 3 = 0").selectExpr("c_custkey", "'changed' as c_mktsegment", "case when c_custkey % 2 = 0 then 1 else 7 end as version")
    return recovery.cas_update(now, change, ["c_custkey"], "version")[0]


@query(f"{OPS} SELECT failure_class, CASE failure_class WHEN 'validation' THEN 'quarantine' ELSE 'retry' END AS disposition, count(*) AS n FROM att WHERE failure_class IS NOT NULL GROUP BY 1, 2")
def l01_failure_disposition(spark, d):
    a = v.ops_attempts(spark, d).filter("failure_class is not null")
    return a.groupBy("failure_class", recovery.failure_disposition(F.col("failure_class")).alias("disposition")).agg(F.count("*").alias("n"))


@query(f"""{OPS}, b AS (SELECT work_item_id, attempt_number, failure_class, CASE WHEN failure_class = 'validation' THEN 'quarantine' WHEN attempt_number >= 3 THEN 'permanent' ELSE 'retry' END AS disposition,
greatest(least(60000000, 1000000 * (1 << (least(attempt_number, 3) - 1))), CASE WHEN failure_class = 'http_429' THEN duration_microseconds * 1000 END) AS base0 FROM att WHERE failure_class IS NOT NULL)
SELECT work_item_id, attempt_number, disposition, CAST(CASE WHEN disposition = 'retry' THEN base0 END AS BIGINT) AS base_microseconds FROM b""")
def l02_retry_schedule(spark, d):
    f = v.ops_attempts(spark, d).filter("failure_class is not null").select("work_item_id", "failure_class", "attempt_number", F.col("finished_at").alias("observed_at"), (F.col("duration_microseconds") * 1000).alias("http_429_delay"))
    return recovery.retry_schedule(f, 42).select("work_item_id", "attempt_number", "disposition", "base_microseconds")


@query(f"{OPS} SELECT work_item_id FROM wrk WHERE run_id = 'run_0' AND (state = 'pending' OR state = 'retry_wait' AND available_at <= {v.NOW})")
def l04_claimable(spark, d):
    return recovery.claimable(v.ops_work(spark, d), v.ops_runs(spark, d), v.now()).select("work_item_id")


@query(f"{OPS} SELECT work_item_id FROM wrk WHERE state = 'running' AND lease_expires_at <= {v.NOW}")
def l05_expired_leases(spark, d):
    return recovery.expired_leases(v.ops_work(spark, d), v.now()).select("work_item_id")


@query(f"{OPS} SELECT work_item_id, 'retry_wait' AS state, CAST(completed_attempt_count + 1 AS INTEGER) AS completed_attempt_count, {v.NOW} + 5 AS available_us FROM wrk WHERE state = 'running' AND lease_expires_at <= {v.NOW}")
def l06_recover_expired(spark, d):
    _, work = recovery.recover_expired(v.ops_work(spark, d), v.now(), F.timestamp_micros(F.lit(v.NOW + 5)))
    return work.select("work_item_id", "state", "completed_attempt_count", F.unix_micros("available_at").alias("available_us"))


_CASES = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in recovery.SEVERITY_OF.items())
_FOUND = f"""{OPS}, {v.SQL_FILES}, {v.SQL_IDEM}, made AS (SELECT DISTINCT o_custkey AS u, true AS has FROM orders WHERE o_orderkey % 41 <> 0),
f AS (SELECT w.*, h.version AS head, a.n AS n_att, coalesce(made.has, false) AS has, w.state = 'running' AND active_attempt_number IS NOT NULL AND lease_expires_at <= {v.NOW} AS gone
  FROM wrk2 w LEFT JOIN heads h USING (run_id, node_id, partition_key) LEFT JOIN (SELECT work_item_id, count(*) AS n FROM att GROUP BY 1) a USING (work_item_id) LEFT JOIN made ON w.u = made.u),
wk AS (SELECT run_id, work_item_id, 'checkpoint_frontier_mismatch' AS kind FROM f WHERE head IS NULL OR head <> expected_checkpoint_version
UNION ALL SELECT run_id, work_item_id, 'attempt_history_mismatch' FROM f WHERE n_att <> completed_attempt_count
UNION ALL SELECT run_id, work_item_id, 'work_retry_waiting' FROM f WHERE state = 'retry_wait'
UNION ALL SELECT run_id, work_item_id, 'work_running_without_lease' FROM f WHERE state = 'running' AND active_attempt_number IS NULL
UNION ALL SELECT run_id, work_item_id, 'work_active_lease' FROM f WHERE state = 'running' AND active_attempt_number IS NOT NULL AND lease_expires_at > {v.NOW}
UNION ALL SELECT run_id, work_item_id, CASE WHEN coalesce(head, 0) >= 1 THEN 'checkpoint_frontier_mismatch' WHEN has THEN 'work_expired_with_committed_artifact' ELSE 'work_expired_no_effect' END FROM f WHERE gone
UNION ALL SELECT run_id, work_item_id, 'checkpoint_frontier_mismatch' FROM f WHERE state = 'succeeded' AND coalesce(head, 0) < 1
UNION ALL SELECT run_id, work_item_id, 'work_committed' FROM f WHERE state NOT IN ('pending', 'retry_wait', 'running')),
k AS (SELECT run_id, work_item_id, NULL AS artifact_id, kind FROM wk
UNION ALL SELECT run_id, NULL, NULL, CASE WHEN state = 'paused' THEN 'run_paused' ELSE 'run_terminal_with_active_work' END FROM runs WHERE state <> 'running'
UNION ALL SELECT DISTINCT run_id, NULL, NULL, 'aggregate_mismatch' FROM nod WHERE node_id IN ('nod_0', 'nod_5')
UNION ALL SELECT NULL, NULL, artifact_id, concat('integrity_', CASE kind WHEN 'invalid_file' THEN 'changed_file' ELSE kind END) FROM iss WHERE kind IS NOT NULL
UNION ALL SELECT NULL, NULL, NULL, CASE WHEN ck % 7 = 0 THEN 'event_frontier_corrupt' ELSE 'stranded_idempotency' END FROM idem WHERE ck % 7 = 0 OR status = 'in_progress')"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    m, f = v.ops_manifests(spark, d), v.ops_files(spark, d)
    return recovery.recovery_findings(*_ops(spark, d), v.ops_heads(spark, d), m, artifacts.artifact_issues(m, f), _records(spark, d), v.now())


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The stored idempotency records; every 7th customer's have a status that there isn't."""
    i = v.ops_idem(spark, d)
    return i.withColumn("status", F.when(F.col("idempotency_key").cast("long") % 7 == 0, "odd").otherwise(F.col("status")))


@query(f"{_FOUND} SELECT run_id, kind, CASE kind {_CASES} ELSE 'healthy' END AS severity, count(*) AS n FROM k GROUP BY 1, 2, 3")
def l07_recovery_findings(spark, d):
    """Findings of every kind; those of the files and the idempotency records belong to no run."""
    return _findings(spark, d).groupBy("run_id", "kind", "severity").agg(F.count("*").alias("n"))


@query(f"{_FOUND} SELECT run_id, work_item_id, artifact_id, kind FROM k")
def l11_all_recovery_findings(spark, d):
    """Each finding, with the work item or the artifact that it is about."""
    return _findings(spark, d).select("run_id", "work_item_id", "artifact_id", "kind")


@query(
    f"{_FOUND}, worst AS (SELECT work_item_id, max(list_position({list(recovery.SEVERITIES)}, CASE kind {_CASES} ELSE 'healthy' END)) AS r FROM wk GROUP BY 1) "
    f"SELECT work_item_id AS run_id, {list(recovery.SEVERITIES)}[coalesce(r, 1)] AS status FROM wrk LEFT JOIN worst USING (work_item_id)"
)
def l08_recovery_status(spark, d):
    """Each work item taken as a run of its own, so that runs in every state occur."""
    own = lambda df: df.withColumn("run_id", F.concat(F.lit("wrk_"), F.regexp_replace("partition_key", "^partition-0*(?=[0-9])", "")))
    work, heads = own(v.ops_work(spark, d)), own(v.ops_heads(spark, d))
    attempts = v.ops_attempts(spark, d).withColumn("run_id", F.col("work_item_id"))
    manifests = own(v.ops_manifests(spark, d))
    runs = work.select("run_id", F.lit("running").alias("state"))
    nodes = runstats.derive_node_aggregates(work, attempts).withColumn("status", F.lit("running"))
    none = v.ops_files(spark, d).filter("false")
    found = recovery.recovery_findings(runs, nodes, work, attempts, heads, manifests, artifacts.artifact_issues(manifests.filter("false"), none), v.ops_idem(spark, d).filter("false"), v.now())
    return recovery.recovery_status(found, runs)


@query(f"{OPS} SELECT work_item_id, state FROM wrk WHERE run_id = 'run_2' AND state = 'running' ORDER BY work_item_id LIMIT 101")
def l09_work_listing(spark, d):
    w = v.ops_work(spark, d).filter("run_id = 'run_2' and state = 'running'")
    return paging.page_frame(w, ["work_item_id"], None, 100).select("work_item_id", "state")


@query(f"{OPS} SELECT outcome, failure_class, count(*) AS n, CAST(sum(duration_microseconds) AS BIGINT) AS total_microseconds, min(duration_microseconds) AS min_microseconds, max(duration_microseconds) AS max_microseconds FROM att GROUP BY 1, 2")
def l10_attempt_outcomes(spark, d):
    return recovery.attempt_outcomes(v.ops_attempts(spark, d)).drop("disposition")


# --- artifacts and listings


@query(f"{FILES} SELECT kind, relative_path, artifact_id, entry_sha256 FROM iss WHERE kind IS NOT NULL")
def k01_artifact_issues(spark, d):
    return artifacts.artifact_issues(v.ops_manifests(spark, d), v.ops_files(spark, d))


@query(f"{FILES}, c AS (SELECT count(*) FILTER (kind = 'missing_file') AS missing_file, count(*) FILTER (kind = 'orphan_file') AS orphan_file, count(*) FILTER (kind = 'invalid_file') AS invalid_file, count(*) FILTER (kind = 'unsafe_entry') AS unsafe_entry FROM iss) SELECT c.*, (SELECT count(*) FROM man) AS manifest_count, (SELECT count(*) FROM fil) AS file_count, (SELECT count(*) FROM man) - missing_file - invalid_file AS verified_count FROM c")
def k04_artifact_report(spark, d):
    m, f = v.ops_manifests(spark, d), v.ops_files(spark, d)
    return artifacts.artifact_report(m, f, artifacts.artifact_issues(m, f)).select("missing_file", "orphan_file", "invalid_file", "unsafe_entry", "manifest_count", "file_count", "verified_count")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'replayed' WHEN o_orderkey % 3 = 1 THEN 'new' ELSE 'conflict' END AS disposition FROM orders")
def s12_register_manifests(spark, d):
    from ..sources.tables import register_manifests

    o = v.table(spark, d, "orders")
    existing = o.filter("o_orderkey % 3 <> 1").selectExpr("concat('art_', o_orderkey) as artifact_id", "concat('p/', o_orderkey) as relative_path", "o_orderkey as row_count")
    incoming = o.selectExpr("concat('art_', o_orderkey) as artifact_id", "concat('p/', o_orderkey) as relative_path", "o_orderkey + case when o_orderkey % 3 = 2 then 1 else 0 end as row_count")
    return register_manifests(existing, incoming).select(F.regexp_replace("artifact_id", "art_", "").cast("long").alias("o_orderkey"), "disposition")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 5000) ORDER BY o_custkey, o_orderkey LIMIT 101")
def k06_keyset_page(spark, d):
    return paging.page_frame(v.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], (100, 5000), 100)


@query("WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'P' END AS o_orderstatus FROM customer), a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) SELECT c_custkey AS o_custkey, f.o_orderstatus, coalesce(n, 0) AS matches, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict FROM f LEFT JOIN a ON c_custkey = o_custkey AND f.o_orderstatus = a.o_orderstatus")
def k22_audit_match(spark, d):
    facts = v.table(spark, d, "customer").selectExpr("c_custkey as o_custkey", "case when c_custkey % 2 = 0 then 'F' else 'P' end as o_orderstatus")
    return paging.audit_match(v.table(spark, d, "orders"), facts)


# --- scalar functions and row pipelines


@query("SELECT event_id, props LIKE '{%' AND regexp_full_match(props, '\\{\"k\": [0-9]+\\}') AS ok, replace(props, ' ', '') AS value, false AS is_canonical FROM events")
def n15_canonical_payload(spark, d):
    p = v.table(spark, d, "events").select("event_id", t.canonical_payload(F.col("props")).alias("p"))
    return p.select("event_id", F.col("p.error").isNull().alias("ok"), "p.value", "p.is_canonical")


@query("SELECT event_id, event_id % 8 IN (0, 1, 2, 3) AS sensitive FROM events")
def n13_sensitive_keys(spark, d):
    """Plain and nested keys, keys written with escapes or long s, keys of a text that is no JSON; words in values and longer words are none."""
    m = F.col("event_id") % 8
    begin = F.when(m == 0, '{"a": {"userPassword": ').when(m == 1, r'{"a": [{"password": ').when(m == 2, '{"API-\u017fecret": ').when(m == 3, '{"broken": , "x_token": ')
    begin = begin.when(m == 4, '{"text": "password", "v": ').when(m == 5, r'{"a": "\"token\": 1", "v": ').when(m == 6, '{"passwords": ').otherwise('{"tokens": ["token"], "v": ')
    end = F.when(m == 0, "}}").when(m == 1, "}]}").otherwise("}")
    e = v.table(spark, d, "events").select("event_id", F.concat(begin, "props", end).alias("j"))
    return e.select("event_id", t.has_sensitive_key(F.col("j")).alias("sensitive"))


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS units, concat('USD ', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)) AS shown FROM part")
def n04_money(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", F.concat(F.lit("USD "), F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("m"))
    m = p.select("p_partkey", t.money_from_text(F.col("m")).alias("m"))
    return m.select("p_partkey", F.col("m.units").alias("units"), t.money_to_text(F.col("m.units"), F.col("m.currency"), F.col("m.exponent")).alias("shown"))


@query("SELECT event_id, epoch_us(ts) - 9000000000 AS us, strftime(ts - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%S.%fZ') AS shown FROM events")
def n06_parse_utc(spark, d):
    """Timestamps written with an offset of two and a half hours, read as instants and written again."""
    wall = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = v.table(spark, d, "events").select("event_id", t.parse_utc(F.concat(wall, F.lit("+02:30"))).alias("x"))
    return e.select("event_id", F.unix_micros("x").alias("us"), t.format_utc(F.col("x")).alias("shown"))


@query("SELECT event_id, CAST(floor(value * 1000000) AS BIGINT) AS us, concat('PT', CAST(floor(value * 1000000) AS BIGINT) // 1000000, '.', lpad(CAST(CAST(floor(value * 1000000) AS BIGINT) % 1000000 AS VARCHAR), 6, '0'), 'S') AS shown FROM events")
def n08_duration(spark, d):
    e = v.table(spark, d, "events").selectExpr("event_id", "cast(floor(value * 1000000) as bigint) as us")
    return e.withColumn("shown", t.format_duration(F.col("us"))).select("event_id", t.parse_duration(F.col("shown")).alias("us"), "shown")


@query("SELECT doc_id, text IS NULL AS missing, coalesce(regexp_matches(text, '^ | $|  |[\\t\\n\\x0B\\f\\r]'), false) AS spaced, coalesce(length(text) > 160 OR octet_length(encode(text)) > 320, false) AS long FROM documents")
def n01_text_rules(spark, d):
    """Which whole documents break the rules of business texts; each rule by itself, as the canonical form tells only the first."""
    long_rows(spark)
    docs = v.table(spark, d, "documents").select("doc_id", "text", t.normalize_text(F.col("text"), 10**9, 10**9, True).alias("n"))
    return docs.select("doc_id", (F.col("n.error").eqNullSafe(F.lit("missing"))).alias("missing"), F.coalesce(F.col("n.error") == "whitespace", F.lit(False)).alias("spaced"), F.coalesce((F.length("text") > 160) | (F.octet_length("text") > 320), F.lit(False)).alias("long"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of the parts: every 7th has a broken field."""
    p = v.table(spark, d, "part")
    k = F.col("p_partkey")
    payload = F.to_json(F.struct(
        F.when(k % 14 == 0, F.lit("bad sku")).otherwise(F.expr("concat('P-', p_partkey)")).alias("sku"), F.col("p_name").alias("name"), F.when(k % 21 == 0, F.lit("-1")).otherwise(F.col("p_size").cast("string")).alias("quantity"),
        F.struct(F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("amount"), F.lit("USD").alias("currency"), F.lit(2).alias("exponent")).alias("unit_price"),
        F.when(k % 35 == 0, F.lit("2026-01-01 00:00:00Z")).otherwise(F.lit("2026-01-01T00:00:00Z")).alias("updated_at"), F.create_map(F.lit("brand"), F.lower(F.col("p_brand")), F.lit("type"), F.lower(F.col("p_type"))).alias("attributes"),
    ))
    return p.select(k.alias("record_index"), F.lit("con_raw").alias("connector_id"), F.concat(F.lit("part "), k.cast("string")).alias("source_record_key"), F.timestamp_micros(F.lit(v.NOW)).alias("captured_at"), payload.alias("payload_json"))


@query("SELECT p_partkey AS record_index, concat('P-', p_partkey) AS sku, p_size AS quantity, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS units FROM part WHERE p_partkey % 14 <> 0 AND p_partkey % 21 <> 0 AND p_partkey % 35 <> 0")
def p02_valid_rows(spark, d):
    valid, _ = ingest.validate_and_split(ingest.normalize_inventory(_raw(spark, d)))
    return valid.select("record_index", "sku", "quantity", F.col("unit_price_minor_units").alias("units"))


@query("SELECT p_partkey AS record_index, concat_ws(',', CASE WHEN p_partkey % 14 = 0 THEN 'sku' END, CASE WHEN p_partkey % 21 = 0 THEN 'quantity' END, CASE WHEN p_partkey % 35 = 0 THEN 'updated_at' END) AS reasons FROM part WHERE p_partkey % 14 = 0 OR p_partkey % 21 = 0 OR p_partkey % 35 = 0")
def p02_quarantine(spark, d):
    _, bad = ingest.validate_and_split(ingest.normalize_inventory(_raw(spark, d)))
    return bad.select("record_index", F.array_join("errors", ",").alias("reasons"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS record_index FROM orders")
def p03_record_index(spark, d):
    return ingest.assign_record_index(v.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_custkey, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n, count(DISTINCT o_orderkey) AS different FROM orders GROUP BY 1 HAVING min(o_orderkey) <> 0 OR max(o_orderkey) <> count(*) - 1")
def p04_check_record_index(spark, d):
    return ingest.check_record_index(v.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("record_index")), ["o_custkey"])


@query("SELECT source, count(*) AS n, CAST(sum(coalesce(octet_length(encode(text)), 0) + coalesce(octet_length(encode(lang)), 0) + coalesce(octet_length(encode(source)), 0)) AS BIGINT) AS text_bytes FROM documents GROUP BY 1 HAVING count(*) > 40")
def p05_batch_limits(spark, d):
    return ingest.check_batch_limits(v.table(spark, d, "documents").select("doc_id", "text", "lang", "source"), ["source"], 40, 1 << 40)


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS split_keys, CAST(16 AS BIGINT) AS partitions, 'partition-00000000' AS first, 'partition-00000015' AS last FROM orders")
def p06_partitions(spark, d):
    """What holds for any assignment: each key is in one partition, and the names are the fixed ones."""
    p = ingest.assign_partition(v.table(spark, d, "orders").select("o_custkey"), ["o_custkey"], 16)
    by_key = p.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("partition_key").alias("low"), F.max("partition_key").alias("high"))
    return by_key.agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.count_if(F.col("low") != F.col("high")).alias("split_keys"), F.count_distinct("low").alias("partitions"), F.min("low").alias("first"), F.max("high").alias("last"))


@query("SELECT count(*) AS records_read, count(*) FILTER (p_partkey % 14 <> 0 AND p_partkey % 21 <> 0 AND p_partkey % 35 <> 0) AS records_written, count(*) FILTER (p_partkey % 14 = 0 OR p_partkey % 21 = 0 OR p_partkey % 35 = 0) AS records_quarantined FROM part")
def p07_pipeline_metrics(spark, d):
    return ingest.pipeline_metrics(ingest.normalize_inventory(_raw(spark, d))).drop("bytes_read")


