"""Files as tasks see them: which are there, what is in them, and what Parquet footers say without their rows.

Listing goes level by level: the folders of a level are rows, and the tasks that read them list them. So neither a file list nor a footer is
ever held by the driver, and a folder of files costs one task, not the driver. Names that begin with ``_`` or ``.`` are left out, as Spark's readers do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Store

BLOCK_BYTES = 8 << 20
#: Bytes that a hashing task gets on average, and footers that a task reads.
TASK_BYTES, TASK_FOOTERS = 64 << 20, 500

FOOTER = "path string, relative_path string, columns array<struct<name:string,type:string>>, row_count long, row_groups array<struct<rows:long,bytes:long>>, error string"


def opened(uri: str):
    """pyarrow's file system of a Hadoop path, the path there, and what stands before it in the URI."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri.split(":", 1)[-1] if uri.startswith("file:") else uri)
    scheme, _, rest = uri.partition("://")
    host, _, path = rest.partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")  # names may hold signs that a URI may not
    at = f"{base.rstrip('/')}/{path}"
    return store, at, uri[: len(uri) - len(at)]


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for b in batches:
        for folder in b["path"]:
            store, at, before = opened(folder)
            found = [x for x in store.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True)) if not x.base_name.startswith(("_", "."))]
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                yield pd.DataFrame({"path": [before + x.path for x in part], "is_dir": [x.type == fs.FileType.Directory for x in part], "byte_size": [x.size or 0 for x in part]})


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """path, relative_path, byte_size of every file below the roots, also of those without a byte. A root may be a file itself."""
    store, files, folders = Store(spark, "listing"), [], []
    for r in roots:
        fs_store, at, before = opened(r.rstrip("/"))
        info = fs_store.get_file_info([at])[0]
        if info.is_file:
            files.append(spark.createDataFrame([(before + at, info.base_name, info.size)], "path string, relative_path string, byte_size long"))
        else:
            folders.append(before + at)
    frontier = spark.createDataFrame([(x, x) for x in folders], "root string, path string")
    n = len(folders)
    while n:
        # a root is the start of its folders' paths
        level = frontier.repartition(min(n, 1000)).mapInPandas(_listed, "root string, path string, is_dir boolean, byte_size long")
        level = store.put(level)
        relative = F.substring("path", F.length("root") + 2, F.length("path"))
        files.append(level.filter("not is_dir").select("path", relative.alias("relative_path"), "byte_size"))
        frontier = level.filter("is_dir").select("root", "path")
        n = frontier.count()
    out = files[0] if files else spark.createDataFrame([], "path string, relative_path string, byte_size long")
    for f in files[1:]:
        out = out.unionByName(f)
    return out


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for root, path in zip(b["root"], b["path"]):
            for found in _children(iter([pd.DataFrame({"path": [path]})])):
                yield found.assign(root=root)[["root", "path", "is_dir", "byte_size"]]


def _dealt(files: DataFrame, most: int) -> DataFrame:
    """files in so many tasks, dealt by path."""
    return files.repartition(max(1, min(10_000, most)), "path")


def hashed_files(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """relative_path, byte_size, sha256 of every file below root; a task holds a block of a file at a time. A file that can't be read has no digest."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                h = hashlib.sha256()
                try:
                    store, at, _ = opened(path)
                    with store.open_input_stream(at) as f:
                        while block := f.read(block_bytes):
                            h.update(block)
                    out.append(h.hexdigest())
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"relative_path": b["relative_path"], "byte_size": b["byte_size"], "sha256": pd.Series(out, dtype="object")})

    files = list_files(spark, root)
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("byte_size"), F.lit(0))).first()
    return _dealt(files, min(n, total // TASK_BYTES + 1)).mapInPandas(digests, "relative_path string, byte_size long, sha256 string")


_PLAIN = {pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string", pa.large_string(): "string", pa.binary(): "binary", pa.large_binary(): "binary", pa.date32(): "date"}


def spark_type(t: pa.DataType) -> str:
    """The simple name of the Spark type that a Parquet column has; a 96-bit time, which Arrow shows in nanoseconds, is a timestamp."""
    if t in _PLAIN:
        return _PLAIN[t]
    if pa.types.is_decimal(t):
        return f"decimal({t.precision},{t.scale})"
    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz or t.unit == "ns" else "timestamp_ntz"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"array<{spark_type(t.value_type)}>"
    if pa.types.is_map(t):
        return f"map<{spark_type(t.key_type)},{spark_type(t.item_type)}>"
    if pa.types.is_struct(t):
        return f"struct<{','.join(f'{f.name}:{spark_type(f.type)}' for f in t)}>"
    return str(t)


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for b in batches:
        out = []
        for path, relative in zip(b["path"], b["relative_path"]):
            try:
                store, at, _ = opened(path)
                with store.open_input_file(at) as f:
                    told = pq.read_metadata(f)
                columns = [{"name": c.name, "type": spark_type(c.type)} for c in told.schema.to_arrow_schema()]
                groups = [{"rows": g.num_rows, "bytes": g.total_byte_size} for g in map(told.row_group, range(told.num_row_groups))]
                out.append((path, relative, columns, told.num_rows, groups, None))
            except (OSError, pa.ArrowInvalid, ValueError) as e:
                out.append((path, relative, None, None, None, f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(out, columns=["path", "relative_path", "columns", "row_count", "row_groups", "error"])


def footers(spark: SparkSession, *roots: str) -> DataFrame:
    """Of every Parquet file below the roots what its own footer says: columns, rows, row groups; an error where it has none. No data page is read."""
    files = list_files(spark, *roots).filter("relative_path like '%.parquet'")
    return _dealt(files, files.count() // TASK_FOOTERS + spark.sparkContext.defaultParallelism).mapInPandas(_footers, FOOTER)


def other_columns(found: DataFrame, schema: T.StructType) -> DataFrame:
    """path, relative_path, told of the files of found (footers) whose columns aren't exactly the expected ones: what their footers say instead."""
    wanted = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    told = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["type"])), ", ")
    return found.select("path", "relative_path", F.coalesce("error", told).alias("told")).filter(F.col("told") != wanted)
