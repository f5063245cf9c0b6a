"""Batches of bounded rows and bytes, row groups, and pages from clustered copies."""

import random

import pytest
from pyspark.sql import functions as F

from crosstally.operators import ingest, paging
from crosstally.schemas import NORMALIZED_SCHEMA
from crosstally.sources import batches, footers, tables


@pytest.mark.parametrize(("max_rows", "max_bytes"), [(7, 10_000), (1000, 50), (5, 60), (1000, 100_000)])
def test_no_batch_breaks_a_limit_and_order_is_kept(spark, max_rows, max_bytes):
    rng = random.Random(max_rows)
    rows = [(rng.choice("aaaab"), i, "x" * rng.choice([0, 1, 9, 40]), None if i % 3 else "y") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, t string, u string")
    cut = batches.cut_batches(df.repartition(5), ["k"], ["i"], max_rows, max_bytes)
    assert ingest.check_batch_limits(cut, ["k", "batch"], max_rows, max_bytes).count() == 0
    got = {}
    for r in cut.collect():
        got.setdefault(r["k"], []).append((r["i"], r["batch"], r["t"], r["u"]))
    assert sorted((k, i, t, u) for k, rs in got.items() for i, _, t, u in rs) == sorted(rows, key=lambda r: (r[0], r[1]))
    for rs in got.values():
        numbers = [b for _, b, *_ in sorted(rs)]
        assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1))
        size = sum(len(t) + len(u or "") for _, _, t, u in rs)
        assert max(numbers) + 1 <= len(rs) // max_rows + size // max(1, max_bytes - 41) + 2  # not many more than are needed


def test_a_row_too_long_for_any_file(spark):
    with pytest.raises(ValueError):
        batches.cut_batches(spark.createDataFrame([(1, "x" * 100)], "i int, t string"), [], ["i"], 10, 99)


def test_files_have_bounded_rows_and_row_groups(spark, tmp_path):
    """A partition of 230 000 rows is written as three files or more, in order, with row groups of 65 536 rows at most."""
    row = [F.lit("A").alias("sku"), F.lit("n").alias("name"), F.lit(1).alias("quantity"), F.lit(1).cast("long").alias("unit_price_minor_units"), F.lit("USD").alias("unit_price_currency"), F.lit(2).cast("tinyint").alias("unit_price_exponent"), F.timestamp_micros(F.col("id")).alias("updated_at"), F.lit("c").alias("connector_id"), F.lit("k").alias("source_record_key")]
    df = spark.range(230_000).select(F.col("id").alias("record_index"), *row, F.array().cast(NORMALIZED_SCHEMA["attributes"].dataType).alias("attributes"))
    tables.write_normalized(df, f"file://{tmp_path}", "run_1", "nod_1")
    found = footers.footers(spark, f"file://{tmp_path}").collect()
    assert sum(r["row_count"] for r in found) == 230_000 and 3 <= len(found) <= 4
    assert max(r["row_count"] for r in found) <= 100_000 and max(g["rows"] for r in found for g in r["row_groups"]) <= 65_536
    ends = tables.read_normalized(spark, f"file://{tmp_path}").groupBy(F.input_file_name()).agg(F.min("record_index").alias("a"), F.max("record_index").alias("z")).collect()
    spans = sorted((r["a"], r["z"]) for r in ends)
    assert all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


def test_pages_open_a_file_or_two(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted({(f"k{rng.randrange(500):03}", rng.randrange(10**6)) for _ in range(5000)})
    df = spark.createDataFrame(rows, "k string, n int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 10)
    try:
        batches.cluster(df, ["k", "n"], f"{tmp_path}/c")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for after in (None, rows[0], rows[2500], rows[-3], rows[-1], ("zzz", 0), ("", -1)):
        want = [r for r in rows if after is None or r > after][:101]
        assert [tuple(r) for r in batches.clustered_page(spark, f"{tmp_path}/c", df.schema, ["k", "n"], after).collect()] == want
        assert len(batches.clustered_files(spark, f"{tmp_path}/c", ["k", "n"], after, 100)) <= 2
        assert want == [tuple(r) for r in paging.page_frame(df, ["k", "n"], after).collect()]


def test_ranges_have_bounded_rows(spark):
    """A table of few bytes is cut by as many tasks as its rows ask for."""
    batches.RANGE_ROWS, before = 100, batches.RANGE_ROWS
    try:
        cut = batches.cut_batches(spark.range(2000).select(F.lit("a").alias("k"), "id"), ["k"], ["id"], 50, 10_000)
        tasks = cut.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    finally:
        batches.RANGE_ROWS = before
    assert sum(r["n"] for r in tasks) == 2000 and len(tasks) > 4 and max(r["n"] for r in tasks) < 1000
