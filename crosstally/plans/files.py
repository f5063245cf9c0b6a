"""Registered queries of the sources and sinks. Each writes what it derives from the tables to the shared folder and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import artifacts, fingerprint, ingest, repair
from ..schemas import NORMALIZED_SCHEMA
from ..session import Store
from ..sources import tables
from ..sources.batches import cluster, clustered_page, cut_batches
from ..sources.buckets import BucketStore, hashed
from ..sources.footers import footers, list_files, other_columns
from . import views as v
from .catalog import _actions, _ledger, _raw

QUERIES, ORACLES = {}, {}
#: Rows of an exported file.
FILE_ROWS = 1_000_000


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the driver ends."""
    return Store(spark, "files").at


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT * FROM (VALUES ('fewer', 2), ('more', 2), ('order', 2), ('other_type', 2), ('rows', 0)) AS x(what, n) WHERE (SELECT count(*) FROM part) > 0")
def s02_refused_files(spark: SparkSession, d: str) -> DataFrame:
    """Look-alike files, two of each kind, planted among right ones: each is told by its own footer, and reading them is an error that names them."""
    at, df = scratch(spark), v.inv_target(spark, d).select(*NORMALIZED_SCHEMA.names)
    plain = lambda rows, name: rows.repartition(2).write.parquet(f"{at}/{name}")
    tables.write_normalized(df, f"{at}/rows", "run_1", "nod_1")
    plain(df.withColumn("extra", F.lit(1)), "more")
    plain(df.drop("name"), "fewer")
    plain(df.select(*reversed(df.columns)), "order")
    plain(df.withColumn("quantity", F.col("quantity").cast("long")), "other_type")
    told = other_columns(footers(spark, at), NORMALIZED_SCHEMA)
    try:
        tables.read_normalized(spark, at)
    except ValueError as refused:
        if "part-" not in str(refused):
            raise
    else:
        raise AssertionError("look-alike files were read")
    kinds = spark.createDataFrame([(k,) for k in ("fewer", "more", "order", "other_type", "rows")], "what string")
    return kinds.join(told.select(F.split("relative_path", "/")[0].alias("what"), F.lit(1).alias("one")), "what", "left").groupBy("what").agg(F.count("one").cast("int").alias("n"))


@query("SELECT p_partkey AS record_index, concat('part ', p_partkey) AS source_record_key FROM part")
def s01_raw_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    tables.write_raw(_raw(spark, d), at, "run_1", "nod_source")
    return tables.read_raw(spark, at, check_nulls=True).select("record_index", "source_record_key")


@query(f"WITH {v.SQL_INVENTORY} SELECT sku, k * 2 + copy AS record_index, quantity, units FROM tgt")
def s02_normalized_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    tables.write_normalized(ingest.assign_partition(v.inv_target(spark, d), ["sku"], 4), at, "run_1", "nod_target")
    back = tables.read_normalized(spark, at, check_nulls=True)
    return back.select("sku", "record_index", "quantity", F.col("unit_price_minor_units").alias("units"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_custkey % 10 = 0 AS corrupt FROM customer")
def s07_csv_records(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    c = v.table(spark, d, "customer").selectExpr("c_custkey", "c_name", "case when c_custkey % 10 = 0 then 'none' else cast(c_nationkey as string) end as c_nationkey")
    c.write.option("header", "true").csv(at)
    back = tables.read_csv_records(spark, at, T.StructType.fromDDL("c_custkey long, c_name string, c_nationkey int"))
    return back.select("c_custkey", "c_name", "c_nationkey", F.col(tables.CORRUPT).isNotNull().alias("corrupt"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT NULL, NULL, NULL FROM events WHERE event_id % 10 = 0")
def s08_jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    e = v.table(spark, d, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "user_id", "event_type")))
    e.select(line.alias("value")).write.text(at)
    return tables.read_jsonl_records(spark, at, T.StructType.fromDDL("event_id long, user_id long, event_type string")).drop(tables.CORRUPT)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def s09_export(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    tables.export_parquet(v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), at, "zstd")
    return spark.read.parquet(at)


@query(f"WITH {v.SQL_OPS} SELECT work_item_id, attempt_number, outcome FROM att")
def s10_ops_table(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    v.ops_attempts(spark, d).write.parquet(f"{at}/work_attempts")
    return tables.read_ops_table(spark, at, "work_attempts").select("work_item_id", "attempt_number", "outcome")


@query("SELECT * FROM (VALUES ('missing_file', 1), ('orphan_file', 1), ('invalid_file', 2), ('same_digest', 6)) AS x(kind, n) WHERE (SELECT count(*) FROM lineitem) > 0")
def s11_artifact_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of an export and one without a byte against manifests: one tells another digest, one tells bytes of the empty file, one is of a file that isn't there and one is absent; and reads in one block against reads in many.

    An export has five files at least and as many as its rows ask for, so no task writes or reads more of a larger table. Digests are told for five
    parts, the files by their numbers, and the empty file: all files of a part must have the same one twice.
    """
    at, li = scratch(spark), v.table(spark, d, "lineitem")
    tables.export_parquet(li.repartition(max(5, -(-li.count() // FILE_ROWS))), f"{at}/rows")
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{at}/emptied/deep")
    files = tables.read_artifact_files(spark, at)
    blocks = tables.read_artifact_files(spark, at, block_bytes=1000)
    first, second = sorted(r["relative_path"] for r in files.filter("byte_size > 0").select("relative_path").orderBy("relative_path").limit(2).collect())
    size = F.when(F.col("byte_size") == 0, F.lit(10)).otherwise(F.col("byte_size"))
    said = files.select(F.sha2("relative_path", 256).alias("artifact_id"), "relative_path", size.alias("byte_size"), F.when(F.col("relative_path") == first, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = said.filter(F.col("relative_path") == first).select("artifact_id", F.lit("gone.parquet").alias("relative_path"), "byte_size", "sha256")
    issues = artifacts.artifact_issues(said.filter(F.col("relative_path") != second).unionByName(gone), files)
    again = blocks.select("relative_path", F.struct("byte_size", "sha256").alias("again"))
    place = F.when(F.col("relative_path").like("rows/%"), F.regexp_extract("relative_path", "part-([0-9]+)", 1).cast("long") % 5)
    same = files.join(again, "relative_path", "full_outer").groupBy(place.alias("place")).agg(F.bool_and(F.struct("byte_size", "sha256").eqNullSafe(F.col("again")) & F.col("sha256").isNotNull()).alias("same"))
    return issues.select("kind").unionByName(same.filter("same").select(F.lit("same_digest").alias("kind"))).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('count', 'row_count'), ('more', 'schema'), ('order', 'schema'), ('torn', 'unreadable'), ('gone', 'missing_file'), ('new', 'orphan_file')) AS x(place, kind), (SELECT count(*) AS n FROM orders) WHERE n > 0")
def k03_artifact_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Six files that aren't what their manifests say, and right ones, which stay silent; rows and columns are those of the footers."""
    at, orders = scratch(spark), v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    n = orders.count()
    for name, rows in {"right": orders, "count": orders, "new": orders, "more": orders.withColumn("extra", F.lit(1)), "order": orders.select("o_orderstatus", "o_orderkey")}.items():
        rows.repartition(1).write.parquet(f"{at}/{name}")
    orders.select(F.to_json(F.struct("*")).alias("value")).repartition(1).write.text(f"{at}/json")
    torn = list_files(spark, f"{at}/json").filter("relative_path like '%.txt'").first()["path"]
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(torn).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(torn), path(f"{at}/json/torn.parquet"))
    found = footers(spark, at)
    place = F.split("relative_path", "/")[0]
    said = found.select("relative_path", place.alias("place")).filter("place <> 'new'").select("relative_path", F.lit(n).cast("long").alias("row_count"), "place")
    said = said.select("relative_path", (F.col("row_count") + (F.col("place") == "count").cast("int")).alias("row_count"))
    said = said.unionByName(spark.createDataFrame([("gone/part.parquet", n)], "relative_path string, row_count long"))
    told = artifacts.artifact_contents(found, said, orders.schema)
    return told.select(F.when(place == "json", "torn").otherwise(place).alias("place"), "kind", F.lit(n).cast("long").alias("n"))


@query(f"WITH {v.SQL_INVENTORY} SELECT 'round_trip' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'damaged', count(*) FROM tgt WHERE sku LIKE '%9'")
def p08_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What is written is read again; a copy that lost rows is told by them."""
    df, at = v.inv_target(spark, d).select(*NORMALIZED_SCHEMA.names), scratch(spark)
    count = lambda rows, what: rows.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    damaged = ingest.frame_differences(df, df.filter("sku not like '%9'")).filter("only_in = 'written'")
    return count(ingest.round_trip_differences(df, at), "round_trip").unionByName(count(damaged, "damaged"))


def _stored_target(spark: SparkSession, d: str) -> tuple[BucketStore, DataFrame]:
    """The target in 64 buckets, and the repairs that its outcomes ask for, stored: rounds read them and derive nothing again."""
    target = v.inv_target(spark, d).select(*NORMALIZED_SCHEMA.names)
    store = BucketStore(spark, f"{scratch(spark)}/target", NORMALIZED_SCHEMA, hashed("sku", 64), 64)
    store.publish(target)
    return store, Store(spark, "actions").put(_actions(spark, d))


@query(f"WITH {v.SQL_INVENTORY}, act AS (SELECT sku FROM outcome WHERE classification IN ('missing_from_target', 'field_mismatch')) SELECT sku, name, quantity, units FROM tgt WHERE sku NOT IN (SELECT sku FROM act) UNION ALL SELECT sku, name, quantity, units FROM ref WHERE sku IN (SELECT sku FROM act)")
def x07_bucketed_target(spark: SparkSession, d: str) -> DataFrame:
    """Every repair applied to a stored target, bucket by bucket, in two rounds."""
    store, actions = _stored_target(spark, d)
    some = F.col("canonical_key").like("%1")
    for part in (actions.filter(some), actions.filter(~some)):
        repair.apply_to_buckets(store, part, _ledger(spark))
    return store.read().select("sku", "name", "quantity", F.col("unit_price_minor_units").alias("units"))


@query(f"WITH {v.SQL_INVENTORY}, act AS (SELECT sku FROM outcome WHERE classification IN ('missing_from_target', 'field_mismatch') AND sku LIKE '%1'), t AS (SELECT sku FROM tgt WHERE sku NOT IN (SELECT sku FROM act) UNION ALL SELECT sku FROM ref WHERE sku IN (SELECT sku FROM act)) SELECT 'kept_up' AS what, count(*) AS n FROM t UNION ALL SELECT 'made_anew', count(*) FROM t UNION ALL SELECT 'fingerprints', 1")
def f05_kept_up_to_date(spark: SparkSession, d: str) -> DataFrame:
    """The stored tree after the repairs of some keys, and the fingerprint made anew of the whole target: the same rows, one fingerprint."""
    store, actions = _stored_target(spark, d)
    tree = fingerprint.StateTree(spark, f"{scratch(spark)}/tree", "inventory")
    tree.create(store.read(), fingerprint.canonical_effect())
    repair.apply_to_buckets(store, actions.filter("canonical_key like '%1'"), _ledger(spark), tree)
    both = tree.fingerprint().withColumn("what", F.lit("kept_up")).unionByName(fingerprint.inventory_fingerprint(store.read()).withColumn("what", F.lit("made_anew")))
    both = Store(spark, "both").put(both)  # two rows, read twice
    return both.select("what", "n").unionByName(both.select("fingerprint").distinct().agg(F.lit("fingerprints").alias("what"), F.count("*").alias("n")))


@query("SELECT l_returnflag, count(*) AS n, CAST(0 AS BIGINT) AS broken, CAST(sum(l_orderkey) AS BIGINT) AS told FROM lineitem GROUP BY 1")
def p05_cut_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three partitions of very different sizes cut into batches of 1 000 rows or 8 000 bytes of text: none breaks the limits, numbers follow the order, no row is lost."""
    li = v.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_linestatus", F.expr("repeat('x', cast(l_quantity as int))").alias("note"))
    cut = Store(spark, "cut").put(cut_batches(li, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 1000, 8000))  # read four times
    broken = ingest.check_batch_limits(cut, ["l_returnflag", "batch"], 1000, 8000).select("l_returnflag", F.lit(1).alias("bad"))
    ends = cut.groupBy("l_returnflag", "batch").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"), F.max(F.struct("l_orderkey", "l_linenumber")).alias("last"))
    after = ends.select("l_returnflag", (F.col("batch") + 1).alias("batch"), F.col("last").alias("before"))
    crossed = ends.join(after, ["l_returnflag", "batch"]).filter("first < before").select("l_returnflag", F.lit(1).alias("bad"))
    bad = broken.unionByName(crossed).groupBy("l_returnflag").agg(F.count("*").alias("broken"))
    told = cut.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("told"))
    return told.join(bad, "l_returnflag", "left").select("l_returnflag", "n", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"), "told")


@query("SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_custkey > 30 OR o_custkey = 30 AND o_orderkey > 5 ORDER BY o_custkey, o_orderkey LIMIT 101)")
def r10_clustered_page(spark: SparkSession, d: str) -> DataFrame:
    """A page behind a cursor from a clustered copy of all orders."""
    at, o, order = scratch(spark), v.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ("o_custkey", "o_orderkey")
    cluster(o, order, at)
    return clustered_page(spark, at, o.schema, order, (30, 5))
