"""Registered queries of the streaming operators: each writes a log derived from the tables, runs a stream over all of it and reads the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OPS_SCHEMAS
from ..streaming import streams
from . import views as v
from .files import scratch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, d: str, at: str, times: int = 1) -> None:
    """The event log in four files; written again (replays) for times > 1."""
    e = v.ops_events(spark, d).select(*OPS_SCHEMAS["execution_events"].names)
    for k in range(times):
        e.repartition(4, "run_id").write.mode("append").parquet(f"{at}/log")


def _to_table(stream: DataFrame, at: str, mode: str = "append") -> None:
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/cursor").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {v.SQL_EVENTS} SELECT concat('run_', user_id) AS run_id, sequence_number, kind FROM evs")
def w01_tail_events(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    _log(spark, d, at)
    _to_table(streams.stream_events(spark, f"{at}/log", 2), at)
    return spark.read.schema(OPS_SCHEMAS["execution_events"]).parquet(f"{at}/out").select("run_id", "sequence_number", "kind")


@query(f"WITH {v.SQL_EVENTS} SELECT concat('run_', user_id) AS run_id, count(*) AS n FROM evs GROUP BY user_id")
def w02_ingest_once(spark: SparkSession, d: str) -> DataFrame:
    """Every event arrives twice and is stored once, by keyed state."""
    at = scratch(spark)
    _log(spark, d, at, times=2)
    streams.stream_ingest(streams.stream_events(spark, f"{at}/log", 4), f"{at}/out", f"{at}/cursor").awaitTermination()
    return streams.read_log(spark, f"{at}/out", OPS_SCHEMAS["execution_events"]).groupBy("run_id").agg(F.count("*").alias("n"))


@query(f"WITH {v.SQL_EVENTS}, l AS (SELECT user_id, sequence_number AS s, coalesce(lag(sequence_number) OVER (PARTITION BY user_id ORDER BY sequence_number), 0) AS b FROM evs) SELECT concat('run_', user_id) AS run_id, b + 1 AS gap_from, s - 1 AS gap_to, false AS closed FROM l WHERE s > b + 1")
def w03_live_gaps(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    _log(spark, d, at)
    _to_table(streams.stream_gaps(streams.stream_events(spark, f"{at}/log")), at)
    return spark.read.schema("run_id string, gap_from long, gap_to long, closed boolean").parquet(f"{at}/out")


@query(f"WITH {v.SQL_OPS} SELECT run_id, node_id, count(*) AS attempts, count(*) FILTER (outcome IN ('retry_scheduled', 'lease_expired')) AS retry_count, CAST(sum(duration_microseconds) AS BIGINT) AS duration_microseconds FROM att GROUP BY 1, 2")
def w04_node_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counters in update mode: each batch's rows go to a folder of its own; the last state of a node is the one of most attempts."""
    at = scratch(spark)
    v.ops_attempts(spark, d).repartition(4, "work_item_id").write.parquet(f"{at}/log")
    stream = streams.stream_node_metrics(streams.stream_table(spark, f"{at}/log", OPS_SCHEMAS["work_attempts"], 2))
    take = lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{at}/cursor").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    g = rows.groupBy("run_id", "node_id").agg(F.max_by(F.struct("attempts", "retry_count", "duration_microseconds"), "attempts").alias("x"))
    return g.select("run_id", "node_id", "x.*")


@query("SELECT concat('run_', o_custkey % 100) AS run_id, max(o_orderkey) AS version FROM orders GROUP BY o_custkey % 100")
def w05_checkpoint_heads(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    schema = OPS_SCHEMAS["checkpoints"]
    c = v.table(spark, d, "orders").select(F.expr("concat('run_', o_custkey % 100)").alias("run_id"), F.lit("n").alias("node_id"), F.lit("p").alias("partition_key"), F.col("o_orderkey").alias("version"), F.expr("concat('art_', o_orderkey)").alias("artifact_id"), F.timestamp_micros(v.micros("o_orderdate")).alias("created_at"))
    c.repartition(4, "version").write.parquet(f"{at}/log")
    streams.stream_checkpoints(streams.stream_table(spark, f"{at}/log", schema, 2), f"{at}/out", f"{at}/cursor").awaitTermination()
    return streams.latest_heads(spark, f"{at}/out", schema).select("run_id", "version")
