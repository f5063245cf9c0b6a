"""Tables in buckets, of which a new version rewrites only those that changed.

A version is a small table (a row a bucket) that says which write of each bucket it holds. What no change touched is referred to, not
copied. Old versions stay readable; a version is there once its list is, and two writers of one version are an error for the second.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket__"


class BucketStore:
    """A table below ``at`` in ``n`` buckets, dealt by ``bucket``, a column function with values from 0 to n - 1."""

    def __init__(self, spark: SparkSession, at: str, schema: T.StructType, bucket: Column, n: int):
        self.spark, self.at, self.schema, self.bucket, self.n = spark, at, schema, bucket, n

    def _names(self, folder: str, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [str(s.getPath().getName()) for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(x.removeprefix(f"{kind}=")) for x in found if x.startswith(f"{kind}="))

    def versions(self) -> list[int]:
        return self._names(f"{self.at}/versions", "version")

    def held(self, version: int | None = None) -> dict[int, int]:
        """Of a version (the newest), which write holds each bucket; buckets without rows are left out. At most n entries."""
        version = max(self.versions()) if version is None else version
        rows = self.spark.read.schema("bucket int, written long").parquet(f"{self.at}/versions/version={version}")
        return {r["bucket"]: r["written"] for r in rows.collect()}

    def buckets_of(self, df: DataFrame) -> list[int]:
        """The buckets that rows fall in: n numbers at most."""
        return sorted(r[0] for r in df.select(self.bucket.cast("int").alias(BUCKET)).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets, whose files alone are opened."""
        held = self.held(version)
        wanted = held if buckets is None else {b: held[b] for b in buckets if b in held}
        paths = [f"{self.at}/data/version={w}/{BUCKET}={b}" for b, w in wanted.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def publish(self, rows: DataFrame, touched: Iterable[int] | None = None) -> int:
        """A new version in which the touched buckets (all) hold these rows and nothing else; its number."""
        versions = self.versions()
        version = max(versions, default=-1) + 1
        kept = {} if touched is None or not versions else {b: w for b, w in self.held().items() if b not in set(touched)}
        dealt = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket.cast("int")).hint("rebalance", BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.at}/data/version={version}")
        written = dict.fromkeys(self._names(f"{self.at}/data/version={version}", BUCKET), version)
        listed = self.spark.createDataFrame(sorted((kept | written).items()), "bucket int, written long")
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.at}/versions/version={version}")
        return version


def hashed(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n))
