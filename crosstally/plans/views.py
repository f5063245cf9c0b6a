"""Inventories and history tables derived from the supplied tables, in Spark and - as CTE text - in DuckDB SQL.

The queries of the catalogue run the operators over these views; their sizes grow with the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2026-01-01 in microseconds.
DAY0 = 1_767_225_600_000_000
#: The moment of observation: 2024-07-01, about the middle of the events.
NOW = 1_719_792_000_000_000
#: 2020-01-01, when some active attempts began.
EARLY = 1_577_836_800_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.timestamp_micros(F.lit(NOW))


def micros(c: str) -> Column:
    """Microseconds of a timestamp column without zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def _inventory(keys: DataFrame, connector: str) -> DataFrame:
    a = lambda k, v: F.struct(F.lit(k).alias("key"), F.col(v).alias("value"))
    return keys.select(
        (F.col("k") * 2 + F.col("copy")).alias("record_index"), "sku", "name", F.col("quantity").cast("int").alias("quantity"), F.col("units").cast("long").alias("unit_price_minor_units"), F.lit("USD").alias("unit_price_currency"), F.lit(2).cast("tinyint").alias("unit_price_exponent"),
        F.timestamp_micros(F.lit(DAY0) + F.col("k") * 1_000_000).alias("updated_at"), F.lit(connector).alias("connector_id"), F.concat(F.lit("row "), F.col("k").cast("string"), F.lit(" "), F.col("copy").cast("string")).alias("source_record_key"), F.array(a("brand", "brand"), a("type", "type")).alias("attributes"),
    )


def _with_copies(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.when(F.col("k") % n == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


_UNITS = "cast(cast(p_retailprice as decimal(18,2)) * 100 as bigint)"


def inv_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each part; every 19th twice."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr("concat('P-', p_partkey)").alias("sku"), F.col("p_name").alias("name"), F.col("p_size").alias("quantity"), F.expr(_UNITS).alias("units"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return _inventory(_with_copies(p, 19), "con_reference")


def inv_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts but every 17th, some with another value, every 23rd twice; and a record for each supplier."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 17 <> 0")
    k = F.col("p_partkey")
    p = p.select(
        k.alias("k"), F.expr("concat('P-', p_partkey)").alias("sku"), F.when(k % 29 == 0, F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") + F.when(k % 13 == 0, 1).otherwise(0)).alias("quantity"), (F.expr(_UNITS) + F.when(k % 11 == 0, 1).otherwise(0)).alias("units"),
        F.when(k % 31 == 0, "Brand#X").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"),
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("concat('S-', s_suppkey)").alias("sku"), F.col("s_name").alias("name"), F.lit(1).alias("quantity"), F.lit(100).cast("long").alias("units"), F.lit("none").alias("brand"), F.lit("none").alias("type"))
    return _inventory(_with_copies(p, 23).unionByName(s.withColumn("copy", F.lit(0))), "con_target")


#: Both inventories in DuckDB: sku, name, quantity, units, ts, brand, type, k, copy; and the joined outcome.
SQL_INVENTORY = """
ref0 AS (SELECT p_partkey AS k, concat('P-', p_partkey) AS sku, p_name AS name, p_size AS quantity, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS units, p_brand AS brand, p_type AS type FROM part),
ref AS (SELECT *, 0 AS copy FROM ref0 UNION ALL SELECT *, 1 FROM ref0 WHERE k % 19 = 0),
tgt0 AS (SELECT p_partkey AS k, concat('P-', p_partkey) AS sku, CASE WHEN p_partkey % 29 = 0 THEN concat(p_name, ' v2') ELSE p_name END AS name, p_size + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS quantity,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS units, CASE WHEN p_partkey % 31 = 0 THEN 'Brand#X' ELSE p_brand END AS brand, p_type AS type FROM part WHERE p_partkey % 17 <> 0),
tgt AS (SELECT *, 0 AS copy FROM tgt0 UNION ALL SELECT *, 1 FROM tgt0 WHERE k % 23 = 0 UNION ALL SELECT s_suppkey, concat('S-', s_suppkey), s_name, 1, 100, 'none', 'none', 0 FROM supplier),
rs AS (SELECT sku, count(*) AS n, first(name ORDER BY k, copy) AS name, first(quantity ORDER BY k, copy) AS quantity, first(units ORDER BY k, copy) AS units, first(k ORDER BY k, copy) AS k, first(brand ORDER BY k, copy) AS brand, first(type ORDER BY k, copy) AS type FROM ref GROUP BY sku),
ts AS (SELECT sku, count(*) AS n, first(name ORDER BY k, copy) AS name, first(quantity ORDER BY k, copy) AS quantity, first(units ORDER BY k, copy) AS units, first(k ORDER BY k, copy) AS k, first(brand ORDER BY k, copy) AS brand, first(type ORDER BY k, copy) AS type FROM tgt GROUP BY sku),
j AS (SELECT coalesce(rs.sku, ts.sku) AS sku, coalesce(rs.n, 0) AS source_count, coalesce(ts.n, 0) AS target_count, rs.n = 1 AND ts.n = 1 AS one,
  rs.name AS s_name, ts.name AS t_name, rs.quantity AS s_quantity, ts.quantity AS t_quantity, rs.units AS s_units, ts.units AS t_units, rs.k AS s_k, ts.k AS t_k, rs.brand AS s_brand, ts.brand AS t_brand, rs.type AS s_type, ts.type AS t_type
  FROM rs FULL OUTER JOIN ts ON rs.sku = ts.sku),
flags AS (SELECT *, coalesce(one AND s_name IS DISTINCT FROM t_name, false) AS name_mismatch, coalesce(one AND s_quantity IS DISTINCT FROM t_quantity, false) AS quantity_mismatch, coalesce(one AND s_units IS DISTINCT FROM t_units, false) AS unit_price_mismatch,
  coalesce(one AND s_k IS DISTINCT FROM t_k, false) AS updated_at_mismatch, coalesce(one AND (s_brand IS DISTINCT FROM t_brand OR s_type IS DISTINCT FROM t_type), false) AS attributes_mismatch FROM j),
outcome AS (SELECT sku, source_count, target_count, CASE WHEN source_count > 1 AND target_count > 1 THEN 'duplicate_both' WHEN source_count > 1 THEN 'duplicate_source' WHEN target_count > 1 THEN 'duplicate_target'
  WHEN target_count = 0 THEN 'missing_from_target' WHEN source_count = 0 THEN 'missing_from_source' WHEN name_mismatch OR quantity_mismatch OR unit_price_mismatch OR updated_at_mismatch OR attributes_mismatch THEN 'field_mismatch' ELSE 'match' END AS classification,
  name_mismatch, quantity_mismatch, unit_price_mismatch, updated_at_mismatch, attributes_mismatch FROM flags)"""


def ops_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is an attempt of its user's work item, in order of time; only a user's last one can end otherwise than in a retry."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("t", micros("ts")).selectExpr("event_id", "user_id", "t", "cast(floor(abs(value) * 1000) as bigint) as duration_microseconds")
    e = e.selectExpr("*", "row_number() over (partition by user_id order by t, event_id) as n", "count(*) over (partition by user_id) as of")
    e = e.selectExpr("*", "case when n < of then case when event_id % 11 = 0 then 'lease_expired' else 'retry_scheduled' end when event_id % 5 = 0 then 'failed' when event_id % 5 = 1 then 'quarantined' when event_id % 5 = 2 then 'cancelled' else 'succeeded' end as outcome")
    return e.selectExpr(
        "concat('wrk_', user_id) as work_item_id", "concat('run_', user_id % 3) as run_id", "concat('nod_', user_id % 8) as node_id", "cast(n as int) as attempt_number", "outcome",
        "case when outcome = 'succeeded' then null when outcome = 'lease_expired' then 'timeout' else element_at(array('connection', 'timeout', 'http_429', 'validation'), cast(event_id % 4 as int) + 1) end as failure_class",
        "duration_microseconds", "timestamp_micros(t) as started_at", "timestamp_micros(t + duration_microseconds) as finished_at",
    )


def ops_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work item for each user: its state is what its last attempt says, but every 10th still runs and every 17th waits."""
    a = ops_attempts(spark, sf_dir).groupBy("work_item_id", "run_id", "node_id").agg(F.count("*").alias("n"), F.max_by("outcome", "attempt_number").alias("last"), F.max("finished_at").alias("finished_at"))
    u = F.regexp_replace("work_item_id", "wrk_", "").cast("long")
    state = F.when(u % 10 == 0, "running").when(u % 17 == 0, "retry_wait").otherwise(F.col("last"))
    return a.select(
        "work_item_id", "run_id", "node_id", F.concat(F.lit("partition-"), F.lpad(u.cast("string"), 8, "0")).alias("partition_key"), state.alias("state"), F.lit(1).alias("row_version"), (F.col("n") + F.when(u % 23 == 0, 1).otherwise(0)).cast("int").alias("completed_attempt_count"),
        F.when((u % 10 == 0) & (u % 40 != 0), (F.col("n") + 1).cast("int")).alias("active_attempt_number"), F.when((u % 10 == 0) & (u % 40 != 0), F.timestamp_micros(F.when(u % 30 == 0, F.lit(EARLY)).otherwise(F.lit(NOW - 2_000_000)))).alias("active_attempt_started_at"), F.when(u % 10 == 0, "owner").alias("lease_owner"), F.when(u % 10 == 0, F.when(u % 20 == 0, F.timestamp_micros(F.lit(NOW - 1_000_000))).otherwise(F.timestamp_micros(F.lit(NOW + 1_000_000)))).alias("lease_expires_at"),
        F.when(u % 17 == 0, F.timestamp_micros(F.lit(NOW) - (u % 2) * 10 + 5)).alias("available_at"), F.when(state == "succeeded", 1).otherwise(0).cast("long").alias("expected_checkpoint_version"),
    )


#: ops_attempts as att and ops_work as wrk in DuckDB; times in microseconds.
SQL_OPS = f"""
ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, CAST(floor(abs(value) * 1000) AS BIGINT) AS duration_microseconds, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS of_n FROM events),
ev2 AS (SELECT *, CASE WHEN n < of_n THEN CASE WHEN event_id % 11 = 0 THEN 'lease_expired' ELSE 'retry_scheduled' END WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 5 = 1 THEN 'quarantined' WHEN event_id % 5 = 2 THEN 'cancelled' ELSE 'succeeded' END AS outcome FROM ev),
att AS (SELECT user_id AS u, concat('wrk_', user_id) AS work_item_id, concat('run_', user_id % 3) AS run_id, concat('nod_', user_id % 8) AS node_id, CAST(n AS INTEGER) AS attempt_number, outcome,
  CASE WHEN outcome = 'succeeded' THEN NULL WHEN outcome = 'lease_expired' THEN 'timeout' ELSE (['connection', 'timeout', 'http_429', 'validation'])[event_id % 4 + 1] END AS failure_class, duration_microseconds, t AS started_at, t + duration_microseconds AS finished_at FROM ev2),
wrk AS (SELECT u, work_item_id, run_id, node_id, concat('partition-', lpad(CAST(u AS VARCHAR), 8, '0')) AS partition_key, CASE WHEN u % 10 = 0 THEN 'running' WHEN u % 17 = 0 THEN 'retry_wait' ELSE max_by(outcome, attempt_number) END AS state,
  count(*) + CASE WHEN u % 23 = 0 THEN 1 ELSE 0 END AS completed_attempt_count, CASE WHEN u % 10 = 0 AND u % 40 <> 0 THEN count(*) + 1 END AS active_attempt_number,
  CASE WHEN u % 10 = 0 AND u % 40 <> 0 THEN CASE WHEN u % 30 = 0 THEN {EARLY} ELSE {NOW} - 2000000 END END AS active_attempt_started_at,
  CASE WHEN u % 10 = 0 THEN CASE WHEN u % 20 = 0 THEN {NOW} - 1000000 ELSE {NOW} + 1000000 END END AS lease_expires_at, CASE WHEN u % 17 = 0 THEN {NOW} - (u % 2) * 10 + 5 END AS available_at, count(*) AS n
  FROM att GROUP BY u, work_item_id, run_id, node_id),
wrk2 AS (SELECT *, CASE WHEN state = 'succeeded' THEN 1 ELSE 0 END AS expected_checkpoint_version FROM wrk),
derived AS (SELECT w.run_id, w.node_id, work_total, work_pending, work_running, work_succeeded, work_quarantined, work_failed, work_cancelled, attempts, retry_count, duration_microseconds FROM
  (SELECT run_id, node_id, count(*) AS work_total, count(*) FILTER (state IN ('pending', 'retry_wait')) AS work_pending, count(*) FILTER (state = 'running') AS work_running, count(*) FILTER (state = 'succeeded') AS work_succeeded, count(*) FILTER (state = 'quarantined') AS work_quarantined,
    count(*) FILTER (state = 'failed') AS work_failed, count(*) FILTER (state = 'cancelled') AS work_cancelled FROM wrk GROUP BY 1, 2) w JOIN
  (SELECT run_id, node_id, count(*) AS attempts, count(*) FILTER (outcome IN ('retry_scheduled', 'lease_expired')) AS retry_count, sum(duration_microseconds) AS duration_microseconds FROM att GROUP BY 1, 2) a USING (run_id, node_id)),
nod AS (SELECT run_id, node_id, work_total + CASE WHEN node_id IN ('nod_0', 'nod_5') THEN 1 ELSE 0 END AS work_total, work_pending, work_running, work_succeeded, work_quarantined, work_failed, work_cancelled, retry_count, duration_microseconds, attempts,
  CASE WHEN work_pending + work_running > 0 THEN 'running' ELSE 'succeeded' END AS status FROM derived),
heads AS (SELECT run_id, node_id, partition_key, CASE WHEN u % 29 = 0 THEN 2 WHEN state = 'succeeded' THEN 1 ELSE 0 END AS version FROM wrk WHERE u % 37 <> 0),
runs AS (SELECT run_id, CASE run_id WHEN 'run_0' THEN 'running' WHEN 'run_1' THEN 'succeeded' ELSE 'paused' END AS state FROM wrk GROUP BY run_id)"""


def ops_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored node aggregates: what the history implies, but one work item too many in nodes 0 and 5."""
    from ..operators.runstats import derive_node_aggregates

    d = derive_node_aggregates(ops_work(spark, sf_dir), ops_attempts(spark, sf_dir))
    wrong = F.when(F.col("node_id").isin("nod_0", "nod_5"), 1).otherwise(0)
    status = F.when(F.col("work_pending") + F.col("work_running") > 0, "running").otherwise("succeeded")
    counters = {"records_read": F.col("attempts") * 10, "records_written": F.col("attempts") * 9, "records_quarantined": F.col("attempts"), "bytes_read": F.col("attempts") * 1000, "bytes_written": F.col("attempts") * 900}
    out = d.withColumn("work_total", F.col("work_total") + wrong).withColumn("status", status).withColumn("row_version", F.lit(1))
    out = out.withColumn("finished_at", F.when(F.col("status") == "succeeded", F.col("finished_at")))
    for k, v in counters.items():
        out = out.withColumn(k, v)
    return out.drop("attempts", "work_unknown")


def ops_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ops_attempts(spark, sf_dir).groupBy("run_id").agg(F.min("started_at").alias("created_at"), F.max("finished_at").alias("finished_at"))
    state = F.when(F.col("run_id") == "run_0", "running").when(F.col("run_id") == "run_1", "succeeded").otherwise("paused")
    return a.select("run_id", state.alias("state"), F.lit(1).alias("row_version"), F.sha2("run_id", 256).alias("plan_fingerprint"), "created_at", F.col("created_at").alias("started_at"), F.when(state == "succeeded", F.col("finished_at")).alias("finished_at"))


def ops_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ops_work(spark, sf_dir)
    u = F.regexp_replace("work_item_id", "wrk_", "").cast("long")
    return w.filter(u % 37 != 0).select("run_id", "node_id", "partition_key", F.when(u % 29 == 0, 2).when(F.col("state") == "succeeded", 1).otherwise(0).cast("long").alias("version"))


def ops_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a run here; its events are numbered in order of time; every 97th is lost."""
    e = table(spark, sf_dir, "events").withColumn("t", micros("ts"))
    e = e.selectExpr("event_id", "user_id", "event_type", "t", "row_number() over (partition by user_id order by t, event_id) as sequence_number").filter("event_id % 97 <> 0")
    return e.selectExpr(
        "concat('run_', user_id) as run_id", "cast(sequence_number as bigint) as sequence_number", "event_type as kind", "case when event_id % 2 = 0 then 'run' else 'work_item' end as subject_kind",
        "case when event_id % 2 = 0 then concat('run_', case when event_id % 53 = 0 then user_id + 1 else user_id end) else concat('wrk_', user_id) end as subject_id", "timestamp_micros(t) as occurred_at", "event_id",
    )


SQL_EVENTS = """
evs AS (SELECT * FROM (SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_number, count(*) OVER (PARTITION BY user_id) AS of_n FROM events) WHERE event_id % 97 <> 0)"""


def ops_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, last: the number of the last event that each user's run had."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("last")).select(F.expr("concat('run_', user_id)").alias("run_id"), "last")


def ops_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent requests: an order's priority is the scope, its customer the key, its status the request."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_custkey").cast("string").alias("idempotency_key"), F.sha2("o_orderstatus", 256).alias("request_sha256"), (micros("o_orderdate") + F.col("o_orderkey")).alias("created_at"))


def ops_idem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records of every third customer: those of its first request in each scope."""
    r = ops_requests(spark, sf_dir).filter("cast(idempotency_key as bigint) % 3 = 0")
    g = r.groupBy("scope", "idempotency_key").agg(F.min(F.struct("created_at", "request_sha256")).alias("f"))
    k = F.col("idempotency_key").cast("long")
    status = F.when(k % 2 == 0, "completed").when(k % 5 == 0, "failed").otherwise("in_progress")
    return g.select("scope", "idempotency_key", F.col("f.request_sha256").alias("request_sha256"), status.alias("status"), F.when(status != "in_progress", F.sha2("idempotency_key", 256)).alias("result_sha256"), F.col("f.created_at").alias("created_at"))


SQL_IDEM = """
req AS (SELECT o_orderpriority AS scope, CAST(o_custkey AS VARCHAR) AS idempotency_key, o_custkey AS ck, sha256(o_orderstatus) AS request_sha256, epoch_us(o_orderdate) + o_orderkey AS created_at FROM orders),
idem AS (SELECT scope, idempotency_key, ck, first(request_sha256 ORDER BY created_at, request_sha256) AS request_sha256, CASE WHEN ck % 2 = 0 THEN 'completed' WHEN ck % 5 = 0 THEN 'failed' ELSE 'in_progress' END AS status, min(created_at) AS created_at FROM req WHERE ck % 3 = 0 GROUP BY scope, idempotency_key, ck)"""


def ops_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each order: its path, size and digest."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 41 <> 0")
    return o.selectExpr("concat('art_', o_orderkey) as artifact_id", "concat('run_', o_custkey % 3) as run_id", "concat('nod_', o_custkey % 8) as node_id", "concat('partition-', lpad(o_custkey, 8, '0')) as partition_key", "concat('runs/', o_custkey, '/part-', o_orderkey, '.parquet') as relative_path",
                        "'application/vnd.apache.parquet' as media_type", "1 as schema_version", "o_orderkey as row_count", "o_orderkey * 10 as byte_size", "sha2(cast(o_orderkey as string), 256) as sha256")


def ops_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are there: some are missing, some changed, some of another place."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 43 <> 0")
    return o.selectExpr("case when o_orderkey % 101 = 0 then concat('runs/../', o_orderkey) else concat('runs/', o_custkey, '/part-', o_orderkey, '.parquet') end as relative_path", "o_orderkey * 10 + case when o_orderkey % 47 = 0 then 1 else 0 end as byte_size", "sha2(cast(o_orderkey as string), 256) as sha256")


SQL_FILES = """
man AS (SELECT concat('art_', o_orderkey) AS artifact_id, concat('runs/', o_custkey, '/part-', o_orderkey, '.parquet') AS relative_path, o_orderkey * 10 AS byte_size, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders WHERE o_orderkey % 41 <> 0),
fil AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN concat('runs/../', o_orderkey) ELSE concat('runs/', o_custkey, '/part-', o_orderkey, '.parquet') END AS relative_path, o_orderkey % 101 = 0 AS unsafe, o_orderkey * 10 + CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END AS byte_size, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders WHERE o_orderkey % 43 <> 0),
iss AS (SELECT CASE WHEN f.relative_path IS NULL THEN 'missing_file' WHEN m.relative_path IS NULL THEN 'orphan_file' WHEN m.byte_size <> f.byte_size OR m.sha256 <> f.sha256 THEN 'invalid_file' END AS kind, coalesce(m.relative_path, f.relative_path) AS relative_path, artifact_id, CAST(NULL AS VARCHAR) AS entry_sha256
  FROM man m FULL OUTER JOIN (SELECT * FROM fil WHERE NOT unsafe) f ON m.relative_path = f.relative_path
  UNION ALL SELECT 'unsafe_entry', NULL, NULL, sha256(relative_path) FROM fil WHERE unsafe)"""
