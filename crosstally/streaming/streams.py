"""Structured Streaming forms of the log operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runstats import RETRIED
from ..schemas import OPS_SCHEMAS


def stream_table(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint of the query that reads it is the cursor."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def stream_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The event log from the last durable position on."""
    return stream_table(spark, folder, OPS_SCHEMAS["execution_events"], files_per_batch)


#: Parts, by the hash of the run, in which logs and heads are stored: a batch reads and writes only those of its own runs.
PARTS = 64


def _part() -> Column:
    return F.pmod(F.xxhash64("run_id"), F.lit(PARTS)).cast("int")


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the sub-folders name=<number>, sorted; none if the folder isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath().getName()) for s in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n.removeprefix(f"{name}=")) for n in found if n.startswith(f"{name}="))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _parts(spark: SparkSession, folder: str, schema: T.StructType, paths: list[str]) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("part", T.IntegerType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], full)


#: Rows of a part and batch that one task writes, a file each.
FILE_ROWS = 100_000


def _write_parts(df: DataFrame, folder: str, number: int, keys: Sequence[str]) -> None:
    """As part=/batch=<number>; what an earlier try of the same batch wrote there is replaced.

    A part has as many files as its rows ask for, by a hash of the keys; without that each task would write a file of every part. A rebalance hint
    does nothing here, as streams run without adaptive execution.
    """
    pieces = {r["part"]: -(-r["n"] // FILE_ROWS) for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}  # PARTS rows at most
    dealt = df.withColumn("batch", F.lit(number).cast("long"))
    if pieces:
        of_part = F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair])[F.col("part")]
        dealt = dealt.repartition(sum(pieces.values()), "part", F.pmod(F.xxhash64(*keys), of_part))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(folder)


#: Numbers of a run whose digests were one state when Python kept it; state is by number now, and nothing reads this.
BLOCK_NUMBERS = 256
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State on the executors' disks, of which a batch reads and writes only the keys that it touches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stream_ingest(events: DataFrame, out: str, checkpoint: str, keys: Sequence[str] = ("run_id", "sequence_number")) -> StreamingQuery:
    """Appends events to out/log once each; the same event again is left out, another one with a stored key goes to out/conflicts, once too.

    Spark's own keyed state holds each key once by itself and once a digest of its events, so a batch never looks at the log and no row or group
    passes through Python: what state lets through are the events that no batch had and the keys that no batch had. Of different events with
    one new key, the one with the smallest digest is stored. The log is only ever added to, by part of the run and batch; a batch that runs again
    after a failure has its old state and writes the same rows in the same place. read_log() reads it.
    """
    keyed_state(events.sparkSession)
    names, rest = events.columns, [c for c in events.columns if c not in keys]
    digest = F.substring(F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in rest]), {"ignoreNullFields": "false"}), 256), 1, 32)
    told = events.withColumn("digest_", F.unhex(digest)).unionByName(events.select(*keys), allowMissingColumns=True)  # a key by itself has no digest
    of_key = Window.partitionBy(*keys).orderBy("digest_")  # and stands before its events

    def take(batch: DataFrame, number: int) -> None:
        placed = batch.select("*", F.first(F.col("digest_").isNull()).over(of_key).alias("opened_"), F.row_number().over(of_key).alias("place_"))
        rows = placed.filter("digest_ is not null").select(*names, F.expr("opened_ and place_ = 2").alias("new_"), _part().alias("part")).persist()
        _write_parts(rows.filter("new_").drop("new_"), f"{out}/log", number, keys)
        rows.filter("not new_").select(*names).write.mode("overwrite").parquet(f"{out}/conflicts/batch={number}")
        rows.unpersist()

    fresh = told.dropDuplicates([*keys, "digest_"])
    return fresh.writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The log that stream_ingest wrote."""
    return _parts(spark, f"{out}/log", schema, [f"{out}/log/part={i}" for i in _numbers(spark, f"{out}/log", "part")]).select(*schema.names)


def stream_gaps(events: DataFrame, key: str = "run_id", seq: str = "sequence_number") -> DataFrame:
    """key, gap_from, gap_to, closed: gaps as they open, from state that holds the next expected number of each key.

    Numbers below the expected one are late or repeated and are told as closed (gap_from = gap_to = the number).
    """
    schema = f"{key} string, gap_from long, gap_to long, closed boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else 1
        numbers = sorted({int(n) for b in batches for n in b[seq]})
        rows = []
        for n in numbers:
            if n < expected:
                rows.append((k[0], n, n, True))
            else:
                if n > expected:
                    rows.append((k[0], expected, n - 1, False))
                expected = n + 1
        state.update((expected,))
        yield pd.DataFrame(rows, columns=[key, "gap_from", "gap_to", "closed"])

    return events.select(key, seq).groupBy(key).applyInPandasWithState(step, schema, "expected long", "append", GroupStateTimeout.NoTimeout)


def stream_node_metrics(attempts: DataFrame) -> DataFrame:
    """Counters of each node, kept up to date from completed attempts; for update or complete mode."""
    return attempts.groupBy("run_id", "node_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome").isin(*RETRIED)).alias("retry_count"), F.sum("duration_microseconds").alias("duration_microseconds"), F.max("finished_at").alias("finished_at"))


#: Head files of one tier that are merged into one of the next.
FAN = 8


def _spans(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """The (first, last) batches of the head files below root, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in store.listStatus(path)] if store.exists(path) else []
    done = [n for n in names if n.startswith("span=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(tuple(map(int, n.removeprefix("span=").split("-"))) for n in done)


def _outer(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other one."""
    return [x for x in spans if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans)]


def _tier(span: tuple[int, int]) -> int:
    size, tier = span[1] - span[0] + 1, 0
    while size >= FAN:
        size, tier = size // FAN, tier + 1
    return tier


def _heads(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the highest version of each key; of equal versions the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("version", *[c for c in rest if c != "version"])).alias("x")).select(*keys, "x.*").select(*rows.columns)


HEAD_KEYS = ("run_id", "node_id", "partition_key")


def stream_checkpoints(checkpoints: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Heads of each (run, node, partition), the highest version of each, below out/heads.

    A batch writes the heads among its own rows and reads no others: a file of deltas. FAN files of a tier are merged into one of the next, so a row
    is written again once a tier, and what a batch writes is in proportion to it. Files that a merged one holds go with the next batch, as
    a reader may have begun with them. A late lower version is left behind when files are read together, and goes when they are merged.
    """
    root = f"{out}/heads"

    def take(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        spans = _spans(spark, root)
        kept = _outer(spans)
        for a, b in set(spans) - set(kept):
            _delete(spark, f"{root}/span={a}-{b}")
        _heads(batch, HEAD_KEYS).write.mode("overwrite").parquet(f"{root}/span={number}-{number}")
        kept = _outer([*kept, (number, number)])
        while len(kept) >= FAN and len({_tier(x) for x in kept[-FAN:]}) == 1:
            merged = (kept[-FAN][0], kept[-1][1])
            rows = spark.read.schema(schema).parquet(*[f"{root}/span={a}-{b}" for a, b in kept[-FAN:]])
            _heads(rows, HEAD_KEYS).write.mode("overwrite").parquet(f"{root}/span={merged[0]}-{merged[1]}")
            kept = [*kept[:-FAN], merged]

    return checkpoints.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_heads(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The newest heads that stream_checkpoints wrote: its files, merged as they are read."""
    root = f"{out}/heads"
    paths = [f"{root}/span={a}-{b}" for a, b in _outer(_spans(spark, root))]
    return _heads(spark.read.schema(schema).parquet(*paths), HEAD_KEYS) if paths else spark.createDataFrame([], schema)
