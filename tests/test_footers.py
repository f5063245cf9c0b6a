"""Listing, hashing and footers by tasks."""

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crosstally.operators import artifacts
from crosstally.plans import files
from crosstally.schemas import NORMALIZED_SCHEMA
from crosstally.sources import footers as ft
from crosstally.sources import tables

from .test_history import T0


def test_every_file_is_listed_and_hashed(spark, tmp_path):
    """Nested folders, files of no bytes and names with signs; hidden names are left out; blocks of any size give the same digests."""
    content = {"a.bin": b"x" * 300_001, "e/b c.bin": b"b", "e/f/g/é.txt": b"small", "e/f/empty.parquet": b"", "e/f/_SUCCESS": b"", ".hidden/z": b"z"}
    for name, data in content.items():
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_bytes(data)
    want = {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in content.items() if "_SUCCESS" not in n and ".hidden" not in n}
    for root, block in ((f"file://{tmp_path}/d", 1000), (f"{tmp_path}/d/", 1 << 23)):
        assert {r["relative_path"]: (r["byte_size"], r["sha256"]) for r in tables.read_artifact_files(spark, root, block).collect()} == want
    assert {r["path"] for r in ft.list_files(spark, f"file://{tmp_path}/d").collect()} == {f"file://{tmp_path}/d/{n}" for n in want}
    assert ft.list_files(spark, f"{tmp_path}/none").count() == 0
    m = spark.createDataFrame([("art_1", "e/f/empty.parquet", 5, "0" * 64)], "artifact_id string, relative_path string, byte_size long, sha256 string")
    issues = {r["relative_path"]: r["kind"] for r in artifacts.artifact_issues(m, tables.read_artifact_files(spark, f"{tmp_path}/d")).collect()}
    assert issues["e/f/empty.parquet"] == "invalid_file" and set(issues.values()) == {"invalid_file", "orphan_file"}


def test_types_of_footers_are_those_that_spark_reads(spark, tmp_path):
    ddl = "a tinyint, b smallint, c int, d bigint, e float, f double, g boolean, h string, i binary, j decimal(12,3), k date, l timestamp, m timestamp_ntz, n array<int>, o map<string,bigint>, p struct<x:int,y:array<string>>"
    df = spark.createDataFrame([], ddl)
    for kind in ("INT96", "TIMESTAMP_MICROS", "TIMESTAMP_MILLIS"):
        spark.conf.set("spark.sql.parquet.outputTimestampType", kind)
        df.coalesce(1).write.parquet(f"{tmp_path}/{kind}")
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    found = ft.footers(spark, str(tmp_path)).collect()
    assert len(found) == 3
    for r in found:
        assert [(c["name"], c["type"]) for c in r["columns"]] == [(f.name, f.dataType.simpleString()) for f in df.schema], r["path"]
        assert r["row_count"] == 0 and r["error"] is None


def test_row_groups_and_rows_without_data_pages(spark, tmp_path):
    """Counts come from the footer: they stand even where every data page is destroyed."""
    at = tmp_path / "x.parquet"
    pq.write_table(pa.table({"a": list(range(1000))}), at, row_group_size=300)
    raw = bytearray(at.read_bytes())
    raw[4 : len(raw) - int.from_bytes(raw[-8:-4], "little") - 8] = b"\0" * (len(raw) - int.from_bytes(raw[-8:-4], "little") - 12)
    at.write_bytes(raw)
    (tmp_path / "torn.parquet").write_bytes(b"PAR1 no footer")
    found = {r["relative_path"]: r for r in ft.footers(spark, str(tmp_path)).collect()}
    assert [g["rows"] for g in found["x.parquet"]["row_groups"]] == [300, 300, 300, 100] and found["x.parquet"]["row_count"] == 1000
    assert found["torn.parquet"]["error"] and found["torn.parquet"]["columns"] is None
    m = spark.createDataFrame([("x.parquet", 1000), ("torn.parquet", 1)], "relative_path string, row_count long")
    told = artifacts.artifact_contents(ft.footers(spark, str(tmp_path)), m)
    assert [(r["relative_path"], r["kind"]) for r in told.collect()] == [("torn.parquet", "unreadable")]


@pytest.mark.parametrize(("change", "named"), [
    (lambda df: df.withColumn("extra", F.lit(1)), "extra int"),
    (lambda df: df.drop("name"), "sku string, quantity"),
    (lambda df: df.select("sku", *[c for c in df.columns if c != "sku"]), "sku string, record_index"),
    (lambda df: df.withColumn("unit_price_exponent", F.col("unit_price_exponent").cast("int")), "unit_price_exponent int"),
])
def test_one_look_alike_among_many_files_is_refused_by_name(spark, tmp_path, change, named):
    at, row = f"file://{tmp_path}", (0, "A", "n", 1, 1, "USD", 2, T0, "c", "k", [])
    df = spark.createDataFrame([(i, *row[1:]) for i in range(15)], NORMALIZED_SCHEMA)
    tables.write_normalized(df, f"{at}/side", "run_1", "nod_1")
    assert tables.read_normalized(spark, f"{at}/side").count() == 15
    change(df).coalesce(1).write.parquet(f"{at}/side/zz")
    with pytest.raises(ValueError, match="zz/part-") as refused:
        tables.read_normalized(spark, f"{at}/side")
    assert named in str(refused.value)


def test_exports_have_as_many_files_as_rows_ask_for(spark, monkeypatch):
    """s11: files are bounded in rows; the five parts of twelve files and the empty file have their digests."""
    asked = []
    export = tables.export_parquet
    monkeypatch.setattr(files, "FILE_ROWS", 500)
    monkeypatch.setattr(files.tables, "export_parquet", lambda df, at, *a: (asked.append((df.rdd.getNumPartitions(), df.count())), export(df, at, *a)))
    got = {tuple(r) for r in entry.queries()["s11_artifact_files"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {("missing_file", 1), ("orphan_file", 1), ("invalid_file", 2), ("same_digest", 6)}
    assert len(asked) == 1 and asked[0][0] == -(-asked[0][1] // 500) > 5
