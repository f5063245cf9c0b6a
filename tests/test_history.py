"""Statistics goldens, history checks, recovery, streams, sources."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from crosstally.operators import history as hi
from crosstally.operators import recovery as rv
from crosstally.operators import runstats as rs
from crosstally.plans import files as file_queries
from crosstally.schemas import DISPOSITIONS, NORMALIZED_SCHEMA, OPS_SCHEMAS, RAW_SCHEMA, RUN_TRANSITIONS, WORK_TRANSITIONS, require_schema
from crosstally.sources import tables
from crosstally.streaming import streams

T0 = dt.datetime(2026, 1, 1)


def ops(spark, name, rows):
    """Rows given by some of their columns."""
    schema = OPS_SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture(scope="module")
def golden(spark):
    zero = dict.fromkeys([f.name for f in OPS_SCHEMAS["run_nodes"] if f.dataType.typeName() == "long"], 0)
    alpha = zero | {"run_id": "r", "node_id": "nod_alpha", "status": "partially_succeeded", "work_total": 2, "work_succeeded": 1, "work_quarantined": 1, "records_read": 10, "records_written": 8, "records_quarantined": 2, "bytes_read": 100, "bytes_written": 80, "retry_count": 1, "duration_microseconds": 60}
    beta = zero | {"run_id": "r", "node_id": "nod_beta", "status": "pending", "work_total": 1, "work_pending": 1}
    work = [{"work_item_id": w, "run_id": "r", "node_id": n, "partition_key": "p" + w, "state": s, "completed_attempt_count": k, "expected_checkpoint_version": 0} for w, n, s, k in (("wrk_itemaa", "nod_alpha", "succeeded", 2), ("wrk_itemab", "nod_alpha", "quarantined", 1), ("wrk_itemba", "nod_beta", "pending", 0))]
    att = [{"work_item_id": w, "run_id": "r", "node_id": "nod_alpha", "attempt_number": i, "outcome": o, "duration_microseconds": d, "failure_class": None if o == "succeeded" else "timeout", "started_at": T0, "finished_at": T0 + dt.timedelta(microseconds=d)} for w, i, o, d in (("wrk_itemaa", 1, "retry_scheduled", 10), ("wrk_itemaa", 2, "succeeded", 20), ("wrk_itemab", 1, "quarantined", 30))]
    return ops(spark, "runs", [{"run_id": "r", "state": "running"}]), ops(spark, "run_nodes", [alpha, beta]), ops(spark, "work_items", work), ops(spark, "work_attempts", att)


def test_golden_statistics(golden):
    runs, nodes, work, attempts = golden
    s = rs.run_summary(runs, nodes, attempts).first()
    assert [s[c] for c in ("work_total", "work_pending", "work_succeeded", "work_quarantined", "attempts", "retry_count", "duration_microseconds")] == [3, 1, 1, 1, 3, 1, 60]
    assert [s[f"p{p}_microseconds"] for p in rs.PERCENTS] == [20, 30, 30]
    n = {r["node_id"]: [r["attempts"], *(r[f"p{p}_microseconds"] for p in rs.PERCENTS)] for r in rs.node_statistics(nodes, attempts).collect()}
    assert n == {"nod_alpha": [3, 20, 30, 30], "nod_beta": [0, None, None, None]}
    assert rs.aggregate_drift(nodes, work, attempts).count() == 0 and rs.check_summary(*golden).count() == 0
    assert rs.check_metrics(rs.node_statistics(nodes, attempts)).count() == 0
    assert {r["node_id"]: r["derived_status"] for r in rs.node_status(rs.derive_node_aggregates(work, attempts)).collect()} == {"nod_alpha": "partially_succeeded", "nod_beta": "pending"}
    assert rs.run_outcome(work).first()["outcome"] == "partially_succeeded"


def test_drift_is_found(golden):
    runs, nodes, work, attempts = golden
    wrong = nodes.withColumn("work_total", F.when(F.col("node_id") == "nod_alpha", 9).otherwise(F.col("work_total")).cast("long"))
    assert [tuple(r) for r in rs.aggregate_drift(wrong, work, attempts).collect()] == [("r", "nod_alpha", "work_total", 9, 2)]
    assert [tuple(r) for r in rs.check_metrics(rs.node_statistics(wrong, attempts)).collect()] == [("r", "nod_alpha", "buckets")]
    none = attempts.filter("false")
    assert rs.run_summary(runs, nodes, none).first()["attempts"] == 0 and rs.run_summary(runs, nodes, none).first()["p50_microseconds"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 40, 99, 100, 101, 200, 333])
def test_percentiles_are_nearest_rank(spark, n):
    df = spark.range(n).selectExpr("'r' as run_id", "'n' as node_id", "concat('w', id) as work_item_id", "1 as attempt_number", "(id * 37) % 101 * 5 as duration_microseconds")
    d = sorted((i * 37) % 101 * 5 for i in range(n))
    want = [d[(n * p + 99) // 100 - 1] for p in rs.PERCENTS]
    a, b = rs.node_latency(df).first(), rs.latency_by_rank(df, "run_id", "node_id").first()
    assert [a[f"p{p}_microseconds"] for p in rs.PERCENTS] == [b[f"p{p}_microseconds"] for p in rs.PERCENTS] == want


@pytest.mark.parametrize("lifecycle", [RUN_TRANSITIONS, WORK_TRANSITIONS])
def test_every_pair_of_states(spark, lifecycle):
    pairs = list(itertools.product(lifecycle, lifecycle))
    rows = [(f"k{i}", j, s) for i, p in enumerate(pairs) for j, s in enumerate(p)]
    bad = {r["k"] for r in hi.illegal_transitions(spark.createDataFrame(rows, "k string, n int, state string"), ["k"], "n", lifecycle, 1).collect()}
    assert bad == {f"k{i}" for i, (a, b) in enumerate(pairs) if b not in lifecycle[a]}


def test_contiguity_and_gaps(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 5), ("c", 1), ("c", 1), ("e", 1)], "k string, n long")
    front = spark.createDataFrame([("a", 2), ("b", 5), ("c", 2), ("d", 0), ("f", 1)], "k string, last long")
    assert {r["k"] for r in hi.check_contiguous(log, ["k"], "n", front, "last").collect()} == {"b", "c", "e", "f"}
    for block in (1, 2, 3, 100_000):
        assert {tuple(r) for r in hi.sequence_gaps(log, ["k"], "n", block).collect()} == {("b", 1, 1), ("b", 3, 4)}


def test_snapshot_change(spark):
    a = spark.createDataFrame([(1, "x", 1, "open"), (2, "x", 5, "done"), (3, "x", 1, "open"), (4, "x", 1, "done")], "id int, name string, v int, state string")
    b = spark.createDataFrame([(1, "y", 2, "open"), (2, "x", 4, "done"), (4, "x", 1, "done"), (5, "n", 1, "open")], a.schema)
    got = {tuple(r) for r in hi.check_snapshot_change(a, b, ["id"], ["name"], ["v"], "state", ["done"]).collect()}
    assert got == {(1, "immutable", "name"), (2, "monotonic", "v"), (2, "terminal", "state"), (3, "deleted", "")}


def test_attempt_traces(spark):
    rows = [("a", 1, "attempt_started", 0, "x"), ("a", 1, "attempt_failed", 1, "x"), ("b", 1, "attempt_failed", 1, "x"), ("c", 1, "attempt_started", 2, "x"), ("c", 1, "attempt_succeeded", 1, "y"), ("d", 1, "attempt_started", 0, "x")]
    df = spark.createDataFrame([(w, n, k, T0 + dt.timedelta(seconds=s), c) for w, n, k, s, c in rows], "work_item_id string, attempt_number int, kind string, occurred_at timestamp, context string")
    assert {(r[0], r[2]) for r in hi.check_attempt_traces(df).collect()} == {("b", "start"), ("b", "order"), ("c", "order"), ("c", "context")}


def test_retry_schedule(spark):
    rows = [("w", c, n, T0, None) for c in DISPOSITIONS for n in (1, 2, 3)] + [("w", "http_429", 1, T0, 5_000_000)]
    df = spark.createDataFrame(rows, "work_item_id string, failure_class string, attempt_number int, observed_at timestamp, http_429_delay long")
    got = [r.asDict() for r in rv.retry_schedule(df, 7).collect()]
    for r in got:
        if DISPOSITIONS[r["failure_class"]] != "retry":
            assert r["disposition"] == DISPOSITIONS[r["failure_class"]] and r["delay_microseconds"] is None
        elif r["attempt_number"] == 3:
            assert r["disposition"] == "permanent"
        else:
            start = 10_000 if r["failure_class"] == "sqlite_contention" else 1_000_000
            base = max(start * 2 ** (r["attempt_number"] - 1), r["http_429_delay"] or 0)
            assert r["base_microseconds"] == base and 0 <= r["jitter_microseconds"] <= base // 4
            assert r["available_at"] == T0 + dt.timedelta(microseconds=r["delay_microseconds"])
    assert got == [r.asDict() for r in rv.retry_schedule(df, 7).collect()]
    assert got != [r.asDict() for r in rv.retry_schedule(df, 8).collect()]


def test_idempotency(spark):
    rec = ops(spark, "idempotency_records", [{"scope": "s", "idempotency_key": k, "request_sha256": "h", "status": s, "result_sha256": "r"} for k, s in (("1", "in_progress"), ("2", "completed"), ("3", "failed"))])
    req = spark.createDataFrame([("s", "1", "h", 1), ("s", "2", "h", 1), ("s", "3", "h", 1), ("s", "3", "x", 2), ("s", "9", "h", 1), ("s", "9", "h", 2), ("s", "9", "x", 3)], "scope string, idempotency_key string, request_sha256 string, created_at long")
    got = [r["disposition"] for r in rv.idempotency_begin(rec, req).orderBy("idempotency_key", "created_at").collect()]
    assert got == ["in_progress_replay", "completed_replay", "failed_replay", "conflict", "started", "in_progress_replay", "conflict"]
    res = spark.createDataFrame([("s", "1", "completed", "r"), ("s", "2", "completed", "r"), ("s", "3", "completed", "r"), ("s", "8", "completed", "r")], "scope string, idempotency_key string, status string, result_sha256 string")
    assert [r["verdict"] for r in rv.idempotency_complete(rec, res).orderBy("idempotency_key").collect()] == ["completed", "replay", "conflict", "unknown"]


def test_compare_and_set(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 4)], "id int, x string, v int")
    new, stale = rv.cas_update(now, spark.createDataFrame([(1, "z", 1), (2, "z", 3), (3, "z", 1)], now.schema), ["id"], "v")
    assert sorted(map(tuple, new.collect())) == [(1, "z", 2), (2, "b", 4)] and sorted(r["id"] for r in stale.collect()) == [2, 3]
    assert sorted(map(tuple, rv.insert_absent(now, spark.createDataFrame([(2, "q", 0), (5, "q", 0), (5, "p", 0)], now.schema), ["id"]).collect())) == [(1, "a", 1), (2, "b", 4), (5, "p", 0)]


def test_recovery_findings(spark, golden):
    """Against the rule table written out for single work items."""
    runs, nodes, _, _ = golden
    late, early = T0 + dt.timedelta(hours=1), T0 - dt.timedelta(hours=1)
    cases = {  # state, lease, active attempt, head, expected version, artifact
        "a": ("running", late, 1, 0, 0, False, {"work_active_lease"}),
        "b": ("running", early, 1, 0, 0, False, {"work_expired_no_effect"}),
        "c": ("running", early, 1, 0, 0, True, {"work_expired_with_committed_artifact"}),
        "d": ("running", early, 1, 1, 1, False, {"checkpoint_frontier_mismatch"}),
        "e": ("running", None, 1, 0, 0, False, {"work_running_without_lease"}),
        "f": ("succeeded", None, None, 1, 1, False, {"work_committed"}),
        "g": ("succeeded", None, None, 0, 0, False, {"checkpoint_frontier_mismatch", "work_committed"}),
        "h": ("pending", None, None, None, 0, False, {"checkpoint_frontier_mismatch", "work_pending"}),
        "i": ("retry_wait", None, None, 0, 1, False, {"checkpoint_frontier_mismatch", "work_retry_waiting"}),
    }
    work = ops(spark, "work_items", [{"work_item_id": k, "run_id": "r", "node_id": "n", "partition_key": k, "state": c[0], "lease_expires_at": c[1], "active_attempt_number": c[2], "completed_attempt_count": 0, "expected_checkpoint_version": c[4]} for k, c in cases.items()])
    heads = ops(spark, "checkpoint_heads", [{"run_id": "r", "node_id": "n", "partition_key": k, "version": c[3]} for k, c in cases.items() if c[3] is not None])
    made = ops(spark, "artifact_manifests", [{"run_id": "r", "node_id": "n", "partition_key": k} for k, c in cases.items() if c[5]])
    got = {}
    for r in rv.work_findings(work, ops(spark, "work_attempts", []), heads, made, F.lit(T0)).collect():
        got.setdefault(r["work_item_id"], set()).add(r["kind"])
    assert got == {k: c[6] for k, c in cases.items()}
    issues = spark.createDataFrame([("missing_file", "art_1"), ("invalid_file", "art_2")], "kind string, artifact_id string")
    found = rv.recovery_findings(runs, nodes, work, ops(spark, "work_attempts", []), heads, made, issues, ops(spark, "idempotency_records", [{"status": "in_progress"}, {"status": "odd"}]), F.lit(T0))
    assert {r["artifact_id"]: r["kind"] for r in found.collect() if r["artifact_id"]} == {"art_1": "integrity_missing_file", "art_2": "integrity_changed_file"}
    assert {"integrity_missing_file", "stranded_idempotency", "event_frontier_corrupt", "aggregate_mismatch"} <= {r["kind"] for r in found.collect()}
    assert rv.recovery_status(found, runs).first()["status"] == "ambiguous"
    _, rows = rv.recover_expired(work, F.lit(T0), F.lit(late))
    assert {r["work_item_id"]: r["state"] for r in rows.collect()} == dict.fromkeys("bcd", "retry_wait")


def test_streams(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [{"run_id": "r", "sequence_number": n, "kind": k, "subject_kind": "run", "subject_id": "r", "occurred_at": T0} for n, k in ((1, "a"), (2, "a"), (5, "a"))]
    e = ops(spark, "execution_events", rows)
    e.coalesce(1).write.parquet(f"{at}/log")
    late = ops(spark, "execution_events", [rows[0], rows[1] | {"kind": "other"}, rows[0] | {"sequence_number": 3}])
    late.coalesce(1).write.mode("append").parquet(f"{at}/log")
    for _ in range(2):  # the second run finds nothing new
        streams.stream_ingest(streams.stream_events(spark, f"{at}/log", 1), f"{at}/out", f"{at}/c1").awaitTermination()
    read = lambda p: sorted((r["sequence_number"], r["kind"]) for r in spark.read.option("recursiveFileLookup", "true").schema(e.schema).parquet(p).collect())
    assert len(read(f"{at}/out/log")) == 4 and len({n for n, _ in read(f"{at}/out/log")}) == 4
    assert len(read(f"{at}/out/conflicts")) == 1
    q = streams.stream_gaps(streams.stream_events(spark, f"{at}/log", 1)).writeStream.format("parquet").option("path", f"{at}/gaps").option("checkpointLocation", f"{at}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    gaps = [tuple(r) for r in spark.read.schema("run_id string, gap_from long, gap_to long, closed boolean").parquet(f"{at}/gaps").collect()]
    assert ("r", 3, 4, False) in gaps or ("r", 4, 4, False) in gaps


def test_partition_keys_in_paths(spark, tmp_path):
    """Keys that differ in case or hold signs of paths have folders of their own, and come back from them."""
    at, keys = f"file://{tmp_path}", ["a", "A", "a/b", "..", "x=1", "\u00e9"]
    row = ("A", "n", 1, 1, "USD", 2, T0, "c", "k", [])
    df = spark.createDataFrame([(i, *row) for i, _ in enumerate(keys)], NORMALIZED_SCHEMA)
    named = df.withColumn("partition_key", F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("record_index").cast("int") + 1))
    tables.write_normalized(named, at, "run_1", "nod_1")
    found = spark.read.parquet(f"{at}/normalized-run_1-nod_1").select("record_index", tables.partition_key_of(F.col("key").cast("string")).alias("k")).collect()
    assert {r["record_index"]: r["k"] for r in found} == dict(enumerate(keys))


def test_ranks_with_ties(spark):
    rows = [{"run_id": "r", "node_id": n, "work_item_id": f"w{i}", "attempt_number": 1, "duration_microseconds": d} for i, (n, d) in enumerate([("a", 5), ("a", 5), ("a", 1), ("b", 3), ("a", 9), ("a", 5)])]
    got = rs.ranked_attempts(ops(spark, "work_attempts", rows), "run_id", "node_id").collect()
    assert {r["work_item_id"]: (r["rank"], r["of"]) for r in got} == {"w2": (1, 5), "w0": (2, 5), "w1": (3, 5), "w5": (4, 5), "w4": (5, 5), "w3": (1, 1)}


def test_sources_reject(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{at}/x")
    with pytest.raises(ValueError):
        tables.read_raw(spark, f"{at}/x")
    with pytest.raises(ValueError):
        require_schema(spark.range(1), RAW_SCHEMA)
    row = (0, "A", "n", 1, 1, "USD", 2, T0, "c", "k", [])
    tables.write_normalized(spark.createDataFrame([row], NORMALIZED_SCHEMA), at, "run_1", "nod_1")
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_normalized(spark.createDataFrame([row], NORMALIZED_SCHEMA), at, "run_1", "nod_1")
    tables.write_normalized(spark.createDataFrame([row[:2] + (None,) + row[3:]], NORMALIZED_SCHEMA), at, "run_2", "nod_1")
    with pytest.raises(ValueError):
        tables.read_normalized(spark, f"{at}/normalized-run_2-nod_1", check_nulls=True)
    with pytest.raises(ValueError):
        tables.export_parquet(spark.range(1), f"{at}/y", "other")
    assert file_queries.scratch(spark).startswith("file:")
