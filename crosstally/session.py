"""Help with sessions: the package on the workers' path, and tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def on_workers(spark: SparkSession) -> None:
    """Puts the folder that holds this package on the Python workers' path, wherever the driver was started. Where executors don't have it, install the package there."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


def long_rows(spark: SparkSession, n: int = 1000) -> None:
    """Arrow batches of at most n rows: documents are long, and the default of 10 000 makes batches of tens of MB for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > n:
        spark.conf.set(key, str(n))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets one of our own; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "crosstally-shared")
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Store:
    """A folder of its own in the shared folder, for tables that are read more than once: what it stores isn't computed again, and a lost executor costs a read.

    drop() deletes it. What a returned DataFrame still reads stays until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.at}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{self.n}")

    def drop(self) -> None:
        atexit.unregister(self.drop)
        with suppress(Exception):  # a session may be gone, and its folder with it
            remove(self.spark, self.at)
