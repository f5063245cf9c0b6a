"""Cutting ordered partitions into files of bounded rows and bytes, and pages over clustered copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Store

#: Limits of a file, and the rows of a row group.
MAX_ROWS, MAX_BYTES, GROUP_ROWS = 100_000, 64 << 20, 65_536
#: Rows of a range of the sort, about: the number of ranges grows with the table, what a task sorts doesn't.
RANGE_ROWS = 250_000


def text_bytes(df: DataFrame) -> Column:
    """Bytes of a row's texts."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        if f.dataType.simpleString() == "string":
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
    return size


def cut_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df with ``batch``: each key's rows in order, in batches of at most max_rows rows and max_bytes bytes of text, numbered from 0.

    Every row gets the rows and bytes before it in its key: those of the ranges before, from one row a key and range, and those before it in its
    own range of the sort. A batch ends where either count passes a multiple of its limit, the bytes' one less the longest row's. So a key of
    any size is cut by many tasks at once, and no order is lost. A row that is larger than a file may be is an error.
    """
    keys, store = list(keys), Store(df.sparkSession, "batches")
    sized = df.withColumn("size_", text_bytes(df))
    total, longest = sized.agg(F.count("*"), F.coalesce(F.max("size_"), F.lit(0))).first()
    if longest > max_bytes:
        raise ValueError(f"a row has {longest} bytes of text, more than {max_bytes}")
    n = -(-max(total, 1) // RANGE_ROWS)
    placed = store.put(sized.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("at_", F.monotonically_increasing_id())).withColumn("range_", F.shiftright("at_", 33))
    here = Window.partitionBy(*keys, "range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)  # a range of the sort
    ahead = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = placed.groupBy(*keys, "range_").agg(F.count("*").alias("n_"), F.sum("size_").alias("b_"))
    sums = sums.select(*keys, "range_", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}before_") for c in ("n_", "b_")])
    dealt = placed.repartition(n, *keys, "range_")  # a number of our own is kept, where Spark would put ranges together by their compressed bytes
    rows = dealt.withColumn("n_", F.count("*").over(here)).withColumn("b_", F.coalesce(F.sum("size_").over(here), F.lit(0))).join(sums, [*keys, "range_"])
    room = max(1, max_bytes - longest)
    rows = rows.withColumn("cell_", F.struct(F.expr(f"(n_ + n_before_) div {max_rows}").alias("r"), F.expr(f"(b_ + b_before_) div {room}").alias("b")))
    cells = store.put(rows.groupBy(*keys, "cell_").agg(F.count("*").alias("rows_")))  # a row a batch
    numbered = cells.select(*keys, "cell_", (F.row_number().over(Window.partitionBy(*keys).orderBy("cell_")) - 1).cast("int").alias("batch"))
    return rows.join(numbered, [*keys, "cell_"]).select(*df.columns, "batch")


def cluster(df: DataFrame, order: Sequence[str], at: str) -> None:
    """A copy of df sorted by its keys over many files, and what each file's first and last keys and rows are."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode("errorifexists").parquet(f"{at}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")
    key = F.struct(*order)
    zones = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))
    zones.orderBy("first").write.mode("errorifexists").parquet(f"{at}/zones")


def clustered_files(spark: SparkSession, at: str, order: Sequence[str], after: tuple | None, limit: int) -> list[str]:
    """The files that a page after the cursor lies in: of those that end behind it, as many as have limit + 1 rows besides the first."""
    zones = spark.read.parquet(f"{at}/zones")
    if after is not None:
        zones = zones.filter(F.col("last") > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after)]))
    found, rows = [], 0
    for z in zones.orderBy("first").limit(limit + 2).collect():  # every file has a row at least
        if rows > limit:
            break
        found.append(z["path"])
        rows += z["n"] if len(found) > 1 or after is None else 0  # how many of the first lie behind the cursor isn't known
    return found


def clustered_page(spark: SparkSession, at: str, df_schema, order: Sequence[str], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """paging.page_frame over a clustered copy: the same rows, from the one or two files that hold them."""
    from ..operators.paging import page_frame

    files = clustered_files(spark, at, order, after, limit)
    rows = spark.read.schema(df_schema).parquet(*files) if files else spark.createDataFrame([], df_schema)
    return page_frame(rows, list(order), after, limit)
