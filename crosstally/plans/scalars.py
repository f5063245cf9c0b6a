"""Registered queries of the scalar rules and of the listings, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import paging, recovery, runstats
from . import views as v

QUERIES, ORACLES = {}, {}
OPS = f"WITH {v.SQL_OPS}"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, regexp_full_match(upper(p_brand), '[A-Z0-9]+(-[A-Z0-9]+)*') AND length(p_brand) <= 64 AS brand_ok, p_partkey % 3 <> 0 AS built_ok FROM part")
def n02_sku(spark, d):
    p = v.table(spark, d, "part")
    built = F.when(F.col("p_partkey") % 3 == 0, F.expr("concat('P--', p_partkey)")).otherwise(F.expr("concat('P-', p_partkey)"))
    return p.select("p_partkey", t.valid_sku(F.upper("p_brand")).alias("brand_ok"), t.valid_sku(built).alias("built_ok"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS ok FROM orders")
def n03_quantity(spark, d):
    k = F.col("o_orderkey")
    shown = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("-"), (k + 1).cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("9999999999"), k.cast("string")))
    return v.table(spark, d, "orders").select("o_orderkey", t.valid_quantity(shown).alias("ok"))


@query("SELECT c_custkey, c_custkey % 8 <= 6 AS ok FROM customer")
def n05_money_bounds(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", t.valid_money(F.floor(F.col("c_acctbal") * 100), F.lit("USD"), F.col("c_custkey") % 8).alias("ok"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS shown FROM events")
def n07_format_utc(spark, d):
    return v.table(spark, d, "events").select("event_id", t.format_utc(F.timestamp_micros(v.micros("ts"))).alias("shown"))


_KV = "array<struct<key:string,value:string>>"


@query(
    "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'duplicate_key' WHEN 1 THEN 'key' WHEN 2 THEN 'key' WHEN 3 THEN 'value' WHEN 4 THEN 'value' WHEN 5 THEN 'value' END AS error, "
    "CASE WHEN p_partkey % 9 = 6 THEN concat('brand=', p_brand, ',type=Caf', chr(233), ' ', p_type) WHEN p_partkey % 9 = 7 THEN concat('brand=', p_brand, ',type=') WHEN p_partkey % 9 = 8 THEN concat('brand=', p_brand, ',type=', p_type) END AS shown FROM part"
)
def n09_attributes(spark, d):
    """Repeated, upper-case and over-long keys; values that are too long in characters or bytes or have a space of another kind; decomposed, empty and plain values."""
    p = v.table(spark, d, "part")
    m, kind = F.col("p_partkey") % 9, F.col("p_type")
    first = F.when(m == 0, "brand").when(m == 1, "TYPE").when(m == 2, F.repeat(F.lit("k"), F.lit(65))).otherwise("type")
    value = F.when(m == 3, F.repeat(F.lit("x"), F.lit(257))).when(m == 4, F.repeat(F.lit("\u65e5"), F.lit(171))).when(m == 5, F.concat(kind, F.lit("\u2009x"))).when(m == 6, F.concat(F.lit("Cafe\u0301 "), kind)).when(m == 7, "").otherwise(kind)
    kv = F.array(F.struct(first.alias("key"), value.alias("value")), F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")))
    a = p.select("p_partkey", t.canonical_attributes(kv).alias("a"))
    return a.select("p_partkey", "a.error", F.when(F.col("a.value").isNotNull(), F.array_join(F.transform("a.value", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")).alias("shown"))


@query(f"WITH {v.SQL_INVENTORY} SELECT sku, copy, brand, 'none' AS colour FROM tgt")
def n10_attribute_get(spark, d):
    g = v.inv_target(spark, d)
    return g.select("sku", (F.col("record_index") % 2).cast("int").alias("copy"), t.attribute_get(F.col("attributes"), "brand").alias("brand"), t.attribute_get(F.col("attributes"), "colour", "none").alias("colour"))


@query("SELECT user_id, count(*) FILTER (user_id >= 100) AS ok FROM events GROUP BY 1")
def n11_identifiers(spark, d):
    e = v.table(spark, d, "events").withColumn("ok", t.valid_id(F.concat(F.lit("run_"), F.col("user_id").cast("string")), "run"))
    return e.groupBy("user_id").agg(F.count_if("ok").alias("ok"))


@query("SELECT o_orderkey, regexp_full_match(lower(o_orderpriority), '[a-z0-9]+([-_.:][a-z0-9]+)*') AS ok FROM orders")
def n12_partition_keys(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", t.valid_stable_text(F.lower("o_orderpriority"), "partition_key").alias("ok"))


@query(f"WITH {v.SQL_INVENTORY} SELECT sku, copy, k % 2 = 0 AS sensitive FROM tgt")
def n14_sensitive_attributes(spark, d):
    g = v.inv_target(spark, d)
    even = F.expr("cast(regexp_replace(sku, '^.-', '') as bigint)") % 2 == 0
    kv = F.when(even, F.transform("attributes", lambda a: F.struct(F.concat(F.lit("apiKey_"), a["key"]).alias("key"), a["value"].alias("value")))).otherwise(F.col("attributes"))
    return g.select("sku", (F.col("record_index") % 2).cast("int").alias("copy"), t.has_sensitive_attribute(kv).alias("sensitive"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS ok FROM orders")
def n16_sha256(spark, d):
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return v.table(spark, d, "orders").select("o_orderkey", t.valid_sha256(F.when(F.col("o_orderkey") % 2 == 0, h).otherwise(F.substring(h, 1, 63))).alias("ok"))


@query("SELECT o_orderkey, o_orderkey % 8 IN (0, 7) AS ok FROM orders")
def n17_paths(spark, d):
    """Composed and decomposed names, segments of 255 and 256 bytes, devices, upward and absolute paths, too many segments."""
    k = F.col("o_orderkey")
    name = k.cast("string")
    long = lambda n: F.concat(F.lit("runs/"), F.rpad(name, n, "x"), F.lit("/part.parquet"))
    path = F.when(k % 8 == 0, F.concat(F.lit("runs/\u00e9 "), name, F.lit("/part.parquet"))).when(k % 8 == 1, F.concat(F.lit("runs/../"), name)).when(k % 8 == 2, F.concat(F.lit("/runs/"), name)).when(k % 8 == 3, F.concat(F.lit("a/Con."), name))
    path = path.when(k % 8 == 4, F.concat(F.lit("runs/e\u0301 "), name)).when(k % 8 == 5, long(256)).when(k % 8 == 6, F.concat(F.repeat(F.lit("a/"), F.lit(32)), name)).otherwise(long(255))
    return v.table(spark, d, "orders").select("o_orderkey", t.valid_artifact_path(path).alias("ok"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS ok FROM orders GROUP BY 1")
def n18_enum(spark, d):
    o = v.table(spark, d, "orders").withColumn("ok", t.valid_enum(F.col("o_orderstatus"), ["F", "O"]))
    return o.groupBy("o_orderstatus").agg(F.count_if("ok").alias("ok"))


@query(f"{OPS} SELECT run_id, count(*) AS attempts, quantile_disc(duration_microseconds, 0.5) AS p50_microseconds FROM att GROUP BY 1")
def t04_run_percentiles(spark, d):
    s = runstats.run_summary(v.ops_runs(spark, d), v.ops_nodes(spark, d), v.ops_attempts(spark, d))
    return s.select("run_id", "attempts", "p50_microseconds")


@query(f"{OPS} SELECT state, CASE WHEN state = 'retry_wait' THEN 'pending' ELSE state END AS bucket, count(*) AS n FROM wrk GROUP BY 1, 2")
def t08_buckets(spark, d):
    w = v.ops_work(spark, d)
    return w.groupBy("state", runstats.bucket_of(F.col("state")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"{OPS} SELECT run_id, node_id, retry_count FROM derived")
def t11_retry_counts(spark, d):
    return runstats.derive_node_aggregates(v.ops_work(spark, d), v.ops_attempts(spark, d)).select("run_id", "node_id", "retry_count")


@query(f"""{OPS}, b AS (SELECT work_item_id, attempt_number, failure_class, CAST(greatest(least(60000000, 1000000 * (1 << (attempt_number - 1))), CASE WHEN failure_class = 'http_429' THEN duration_microseconds * 1000 END) AS BIGINT) AS base FROM att WHERE failure_class IS NOT NULL AND failure_class <> 'validation' AND attempt_number < 3),
c AS (SELECT *, least(CASE WHEN failure_class = 'http_429' THEN 86400000000 ELSE 60000000 END - base, base // 4) AS bound FROM b)
SELECT work_item_id, attempt_number, CAST(CAST(concat('0x', substr(sha256(concat_ws('|', 'retry-jitter-v1', '42', work_item_id, failure_class, attempt_number, bound)), 1, 16)) AS UHUGEINT) % CAST(bound + 1 AS UHUGEINT) AS BIGINT) AS jitter_microseconds FROM c""")
def l03_jitter(spark, d):
    f = v.ops_attempts(spark, d).filter("failure_class is not null").select("work_item_id", "failure_class", "attempt_number", F.col("finished_at").alias("observed_at"), (F.col("duration_microseconds") * 1000).alias("http_429_delay"))
    return recovery.retry_schedule(f, 42).filter("disposition = 'retry'").select("work_item_id", "attempt_number", "jitter_microseconds")


@query(f"{OPS} SELECT run_id, 'run_terminal_with_active_work' AS kind FROM runs WHERE state = 'succeeded' UNION ALL SELECT run_id, 'run_paused' FROM runs WHERE state = 'paused'")
def h15_terminal_with_active_work(spark, d):
    return recovery.run_findings(v.ops_runs(spark, d), v.ops_nodes(spark, d), v.ops_work(spark, d))


# --- listings: relation, order columns, cursor


_LISTED = {
    "k06_pipelines": ("pipelines", lambda s, d: v.table(s, d, "part").filter("p_size % 2 = 0").selectExpr("concat('pip_', p_partkey) as pipeline_id"), ("pip_1",), "SELECT concat('pip_', p_partkey) AS pipeline_id FROM part WHERE p_size % 2 = 0"),
    "k07_pipeline_versions": ("pipeline_versions", lambda s, d: v.table(s, d, "part").filter("p_brand = 'Brand#2'").selectExpr("p_partkey as version_number"), (5,), "SELECT p_partkey AS version_number FROM part WHERE p_brand = 'Brand#2'"),
    "k08_connectors": ("connectors", lambda s, d: v.table(s, d, "supplier").selectExpr("concat('con_', s_suppkey) as connector_id"), ("con_2",), "SELECT concat('con_', s_suppkey) AS connector_id FROM supplier"),
    "k09_runs": ("runs", lambda s, d: v.ops_frontier(s, d).select("run_id"), ("run_1",), "SELECT DISTINCT concat('run_', user_id) AS run_id FROM events"),
    "k10_run_nodes": ("run_nodes", lambda s, d: v.ops_nodes(s, d).filter("run_id = 'run_1'").select("node_id"), ("nod_1",), f"{OPS} SELECT node_id FROM nod WHERE run_id = 'run_1'"),
    "k11_work_items": ("work_items", lambda s, d: v.ops_work(s, d).select("work_item_id"), ("wrk_1",), f"{OPS} SELECT work_item_id FROM wrk"),
    "k12_attempts": ("work_attempts", lambda s, d: v.ops_attempts(s, d).filter("work_item_id = 'wrk_8'").select("attempt_number"), (3,), f"{OPS} SELECT attempt_number FROM att WHERE work_item_id = 'wrk_8'"),
    "k13_checkpoints": ("checkpoints", lambda s, d: v.table(s, d, "orders").filter("o_custkey % 100 = 7").selectExpr("o_orderkey as version"), (10,), "SELECT o_orderkey AS version FROM orders WHERE o_custkey % 100 = 7"),
    "k14_events": ("execution_events", lambda s, d: v.ops_events(s, d).filter("run_id = 'run_8'").select("sequence_number"), (2,), f"WITH {v.SQL_EVENTS} SELECT sequence_number FROM evs WHERE user_id = 8"),
    "k16_plans": ("repair_plans", lambda s, d: v.table(s, d, "customer").selectExpr("c_custkey % 10 as created_at", "concat('rpl_', c_custkey) as repair_plan_id"), (3, "rpl_5"), "SELECT c_custkey % 10 AS created_at, concat('rpl_', c_custkey) AS repair_plan_id FROM customer"),
    "k17_actions": ("repair_actions", lambda s, d: v.table(s, d, "orders").selectExpr("concat('SKU-', o_custkey) as canonical_key", "concat('rac_', o_orderkey) as repair_action_id"), ("SKU-5", "rac_1"), "SELECT concat('SKU-', o_custkey) AS canonical_key, concat('rac_', o_orderkey) AS repair_action_id FROM orders"),
    "k18_audit_log": ("audit_entries", lambda s, d: v.table(s, d, "events").selectExpr("event_id as sequence_number"), (77,), "SELECT event_id AS sequence_number FROM events"),
    "k19_manifests": ("artifact_manifests", lambda s, d: v.ops_manifests(s, d).filter("run_id = 'run_2'").select("artifact_id"), ("art_2",), f"WITH m AS (SELECT concat('art_', o_orderkey) AS artifact_id FROM orders WHERE o_orderkey % 41 <> 0 AND o_custkey % 3 = 2) SELECT artifact_id FROM m"),
}


def _literal(x) -> str:
    return f"'{x}'" if isinstance(x, str) else str(x)


for _name, (_listing, _rows, _after, _sql) in _LISTED.items():
    _order = paging.LISTINGS[_listing]
    _cols, _cursor = ", ".join(_order), ", ".join(map(_literal, _after))

    @query(f"SELECT {_cols} FROM ({_sql}) AS x WHERE ({_cols}) > ({_cursor}) ORDER BY {_cols} LIMIT 101", _name)
    def _listed(spark, d, rows=_rows, order=_order, after=_after):
        return paging.page_frame(rows(spark, d), list(order), after, 100).select(*order)
