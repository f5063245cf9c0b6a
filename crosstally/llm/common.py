"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Store, long_rows, remove, shared_dir  # noqa: F401  for the modules of this package

#: White space as the contracts define it (space, tab to carriage return).
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the folder that driver and executors share."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder, so that nothing above is computed again and a lost executor costs a read."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, a stored side of short rows, marked for broadcast if it has been counted to have at most so many; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def named(column: str) -> Column:
    """A column by its exact name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, the same ones on each run: those with the smallest hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit("sample")), F.col(key)).limit(n)
