"""Ingestion by keyed state, heads by deltas, and replays of ranges."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from crosstally.operators import history as hi
from crosstally.schemas import OPS_SCHEMAS
from crosstally.streaming import streams

T0 = dt.datetime(2026, 1, 1)
EVENTS = OPS_SCHEMAS["execution_events"]


def event(run, n, kind="k"):
    return (run, n, kind, "run", None if n % 3 else run, T0 + dt.timedelta(microseconds=n * 7 + 1))


def ingest(spark, at, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{at}/log")
    streams.stream_ingest(streams.stream_events(spark, f"{at}/log", 1), f"{at}/out", f"{at}/c").awaitTermination()


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_ingestion_never_reads_the_log(spark, tmp_path):
    """Fresh events, replays, conflicts and a restart, with the log taken away between batches: what is known comes from state alone."""
    at, want = f"file://{tmp_path}", {}
    streams.BLOCK_NUMBERS, before = 4, streams.BLOCK_NUMBERS
    try:
        for k in range(4):
            fresh = [event(r, n) for r in ("a", "b") for n in range(5 * k + 1, 5 * k + 6)]
            again = [event("a", n) for n in range(max(1, 5 * k - 3), 5 * k + 1)]  # the same events again
            other = [event("b", 5 * k, "other")] if k else []
            ingest(spark, at, fresh + again + other + fresh[:2])
            log = streams.read_log(spark, f"{at}/out", EVENTS).collect()
            got = {(r["run_id"], r["sequence_number"]): tuple(r) for r in log}
            assert len(got) == len(log) == 10 and set(got.values()) == {tuple(e) for e in fresh}
            want |= {e[:2]: e for e in fresh}
            shutil.rmtree(tmp_path / "out" / "log")
    finally:
        streams.BLOCK_NUMBERS = before
    conflicts = spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{at}/out/conflicts").collect()
    assert sorted((r["run_id"], r["sequence_number"], r["kind"]) for r in conflicts) == [("b", n, "other") for n in (5, 10, 15)]


def test_different_events_of_one_new_key(spark, tmp_path):
    """One is stored, the others are conflicts, whichever comes first in the file."""
    at = f"file://{tmp_path}"
    ingest(spark, at, [event("r", 1, "x"), event("r", 1, "y"), event("r", 1, "x"), event("r", 2)])
    log = {(r["sequence_number"], r["kind"]) for r in streams.read_log(spark, f"{at}/out", EVENTS).collect()}
    other = {(r["sequence_number"], r["kind"]) for r in spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{at}/out/conflicts").collect()}
    assert len(log) == 2 and log | other == {(1, "x"), (1, "y"), (2, "k")} and len(other) == 1


def test_ingestion_is_native_and_writes_a_file_a_part(spark, tmp_path):
    """No group passes through Python, a batch writes one file a part however many tasks it has, and a conflict that comes again is left out."""
    at, rows = f"file://{tmp_path}", [event(f"run_{i}", n) for i in range(300) for n in (1, 2, 3)]
    other = [event("run_0", 2, "other"), event("run_1", 3, "other")]
    for batch in (rows, rows + other, other + other[:1]):
        spark.createDataFrame(batch, EVENTS).repartition(4).write.mode("append").parquet(f"{at}/log")
        query = streams.stream_ingest(streams.stream_events(spark, f"{at}/log"), f"{at}/out", f"{at}/c")
        query.awaitTermination()
        assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["dedupe"]
    assert sorted(map(tuple, streams.read_log(spark, f"{at}/out", EVENTS).select("run_id", "sequence_number", "kind").collect())) == sorted(r[:3] for r in rows)
    parts = list((tmp_path / "out" / "log").glob("part=*"))
    assert len(parts) == len(list((tmp_path / "out" / "log").rglob("*.parquet"))) > 32
    conflicts = spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{at}/out/conflicts").collect()
    assert sorted((r["run_id"], r["sequence_number"]) for r in conflicts) == [("run_0", 2), ("run_1", 3)]


def test_a_large_part_of_a_batch_is_many_tasks_work(spark, tmp_path):
    df = spark.range(2500).select(F.lit("hot").alias("run_id"), F.col("id").alias("sequence_number"), F.lit(7).alias("part"))
    streams.FILE_ROWS, before = 500, streams.FILE_ROWS
    try:
        streams._write_parts(df, f"file://{tmp_path}/log", 0, ["run_id", "sequence_number"])
    finally:
        streams.FILE_ROWS = before
    assert len(list((tmp_path / "log").rglob("*.parquet"))) >= 3 and spark.read.parquet(f"file://{tmp_path}/log").count() == 2500


def test_heads_are_written_in_proportion_to_the_batch(spark, tmp_path):
    """Twenty batches: each writes its own rows and a share of merges, few files stay, and a late lower version never wins."""
    at, schema = f"file://{tmp_path}", "run_id string, node_id string, partition_key string, version long"
    full, want, written = spark.createDataFrame([], schema).schema, {}, []
    for k in range(20):
        rows = [(f"run_{k}_{i}", "n", "p", 5) for i in range(50)] + [("hot", "n", "p", k), ("late", "n", "p", 99 - k)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/log")
        seen = {p.name for p in (tmp_path / "out" / "heads").glob("span=*")} if k else set()
        streams.stream_checkpoints(streams.stream_table(spark, f"{at}/log", schema), f"{at}/out", f"{at}/c").awaitTermination()
        for r in rows:
            want[r[0]] = max(want.get(r[0], -1), r[3])
        new = [p for p in (tmp_path / "out" / "heads").glob("span=*") if p.name not in seen]
        written.append(sum(spark.read.parquet(str(p)).count() for p in new))
    heads = streams.latest_heads(spark, f"{at}/out", full).collect()
    assert {r["run_id"]: r["version"] for r in heads} == want and len(heads) == len(want)
    assert sorted(written)[:18] == [52] * 18 and sum(written) <= 20 * 52 * 2  # a batch's own rows; two merges of eight
    spans = streams._spans(spark, f"{at}/out/heads")
    assert len(streams._outer(spans)) <= 2 * streams.FAN and len(spans) <= 3 * streams.FAN


def test_spans():
    assert streams._outer([(0, 0), (0, 7), (3, 3), (8, 8)]) == [(0, 7), (8, 8)]
    assert [streams._tier(x) for x in ((0, 0), (0, 6), (0, 7), (0, 62), (0, 63))] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("block", [3, 1024])
def test_replays_of_ranges(spark, block):
    """Missing, surplus and changed rows of the range are told, numbers outside it aren't, an unchanged range tells nothing."""
    rng = random.Random(block)
    log = [(r, n, f"k{n}") for r in "ab" for n in range(1, 41) if (r, n) not in {("a", 9), ("b", 20)}]
    batch = [(r, n, "x" if n == 30 else k) for r, n, k in log if 5 <= n <= 35 and (r, n) not in {("a", 12), ("b", 7)}] + [("a", 9, "k9"), ("b", 35, "k35")]
    rng.shuffle(batch)
    schema = "run_id string, n long, kind string"
    df = lambda rows: spark.createDataFrame(rows, schema)
    ranges = spark.createDataFrame([("a", 4, 35), ("b", 5, 36)], "run_id string, first long, last long")
    want = {("a", 4, "missing"), ("a", 9, "surplus"), ("a", 12, "missing"), ("a", 30, "conflict"), ("b", 7, "missing"), ("b", 30, "conflict"), ("b", 35, "conflict"), ("b", 36, "missing")}
    assert {tuple(r) for r in hi.range_replay(df(log), df(batch), ["run_id"], "n", ranges, block).collect()} == want
    # by the batch's own ends: 1, 2, 4, 5 against 1 to 5 lacks 3
    some = [("a", n, f"k{n}") for n in (1, 2, 4, 5)]
    assert [tuple(r) for r in hi.range_replay(df(log), df(some), ["run_id"], "n", block=block).collect()] == [("a", 3, "missing")]
    assert hi.range_replay(df(log), df([x for x in log if 3 <= x[1] <= 17]), ["run_id"], "n", block=block).count() == 0
