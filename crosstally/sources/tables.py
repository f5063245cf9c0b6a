"""Readers and writers: inventory tables, record files, operational logs, artifact files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import NORMALIZED_SCHEMA, OPS_SCHEMAS, RAW_SCHEMA, null_violations, require_empty, require_schema
from .batches import GROUP_ROWS, cut_batches
from .footers import BLOCK_BYTES, footers, hashed_files, other_columns

CORRUPT = "corrupt_record"


def _exact(spark: SparkSession, paths: list[str], schema: T.StructType, check_nulls: bool) -> DataFrame:
    """Files whose own schema is exactly the expected one, told by each file's footer. Partition columns of the layout are left out."""
    require_empty(other_columns(footers(spark, *paths), schema).select("path", "told"), f"files with other columns than {schema.simpleString()}")
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
    if check_nulls:
        require_empty(null_violations(df), "null values")
    return df


def read_raw(spark: SparkSession, *paths: str, check_nulls: bool = False) -> DataFrame:
    return _exact(spark, list(paths), RAW_SCHEMA, check_nulls)


def read_normalized(spark: SparkSession, *paths: str, check_nulls: bool = False) -> DataFrame:
    """All files of a side; a file with a column more, fewer, of another type or in another place is an error that names it, nulls are one if asked."""
    return _exact(spark, list(paths), NORMALIZED_SCHEMA, check_nulls)


def path_key(key: Column) -> Column:
    """A partition key as a part of a path: the digits of its bytes, so that no two keys collide, on any file system, and none escapes."""
    return F.lower(F.hex(F.encode(key, "UTF-8")))


def partition_key_of(path_part: Column) -> Column:
    """The partition key that path_key made a part of a path."""
    return F.decode(F.unhex(path_part), "UTF-8")


def _write(df: DataFrame, schema: T.StructType, root: str, dataset: str, run_id: str, node_id: str) -> None:
    extra = [F.lit(dataset).alias("dataset"), F.lit(run_id).alias("run_id"), F.lit(node_id).alias("node_id")]
    key = F.col("partition_key") if "partition_key" in df.columns else F.lit("partition-00000000")
    rows = df.select(*schema.names, *extra, path_key(key).alias("key"))
    require_schema(rows.select(*schema.names), schema)
    # a partition is cut into batches by prefix sums, each one file; a large one is sorted and written by many tasks
    placed = cut_batches(rows, ["key"], ["record_index"]).repartition("key", "batch").sortWithinPartitions("key", "batch", "record_index")
    options = {"compression": "zstd", "parquet.block.size": str(64 << 20), "parquet.block.row.count.limit": str(GROUP_ROWS)}
    placed.write.mode("errorifexists").options(**options).partitionBy("run_id", "dataset", "node_id", "key", "batch").parquet(f"{root}/{dataset}-{run_id}-{node_id}")


def write_raw(df: DataFrame, root: str, run_id: str, node_id: str) -> None:
    """Partition files run_id=/dataset=/node_id=/key=/batch=, each of at most 100 000 rows and 64 MiB of text in row groups of 65 536 rows; an existing destination is an error."""
    _write(df, RAW_SCHEMA, root, "raw", run_id, node_id)


def write_normalized(df: DataFrame, root: str, run_id: str, node_id: str) -> None:
    _write(df, NORMALIZED_SCHEMA, root, "normalized", run_id, node_id)


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Rows with the declared schema; a line that doesn't fit is kept whole in corrupt_record."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.csv(path, schema=full, encoding=encoding, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=False)


def read_jsonl_records(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.json(path, schema=full, encoding=encoding, lineSep="\n", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def export_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Any of the record tables, as a new immutable folder."""
    if compression not in ("none", "snappy", "gzip", "zstd", "lz4"):
        raise ValueError(f"compression {compression!r}")
    df.write.mode("errorifexists").option("compression", compression).parquet(path)


def read_ops_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An operational log table with its declared schema."""
    return spark.read.schema(OPS_SCHEMAS[name]).option("mergeSchema", "false").parquet(f"{root}/{name}")


def read_artifact_files(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """relative_path, byte_size, sha256 of every file below root, those of no bytes too. Files are listed and hashed by tasks, block by block."""
    return hashed_files(spark, root, block_bytes)


def register_manifests(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with a column disposition: new, replayed (all columns equal) or conflict (same id or path, other content).

    Identical rows inside incoming count once; two different incoming rows with one id or path are both conflicts.
    """
    columns = incoming.columns
    rows = incoming.distinct()
    known = existing.select(*columns)
    whole = F.struct(*columns)
    by_id = known.select(F.col("artifact_id").alias("k_id"), whole.alias("same_id"))
    by_path = known.select(F.col("relative_path").alias("k_path"), F.lit(True).alias("path_used"))
    twice = lambda k: rows.groupBy(k).agg((F.count("*") > 1).alias(f"{k}_twice"))
    joined = rows.join(by_id, rows["artifact_id"] == F.col("k_id"), "left").join(by_path, rows["relative_path"] == F.col("k_path"), "left").join(twice("artifact_id"), "artifact_id").join(twice("relative_path"), "relative_path")
    disposition = (
        F.when(F.col("same_id").eqNullSafe(whole), "replayed").when(F.col("same_id").isNotNull() | F.col("path_used") | F.col("artifact_id_twice") | F.col("relative_path_twice"), "conflict").otherwise("new")
    )
    return joined.select(*columns, disposition.alias("disposition"))
