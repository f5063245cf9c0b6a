"""Artifact files against their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import valid_artifact_path
from .fingerprint import inventory_digest

ISSUE_KINDS = ("missing_file", "orphan_file", "changed_file", "invalid_file", "unsafe_entry")


def artifact_issues(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """kind, relative_path, artifact_id, entry_sha256 of every disagreement between manifests and observed files.

    Size and SHA-256 of a file must be those of its manifest. An observed path that isn't safe is told by its hash only.
    """
    # the path rule is judged once; an unsafe path stays in the join, where it meets nothing
    judged = files.select(F.col("relative_path").alias("seen_path"), valid_artifact_path(F.col("relative_path")).alias("safe"), F.struct(F.col("byte_size").alias("n"), F.col("sha256").alias("d")).alias("seen"))
    m = manifests.select("relative_path", "artifact_id", F.struct(F.col("byte_size").alias("n"), F.col("sha256").alias("d")).alias("said"))
    j = m.join(judged, (m["relative_path"] == judged["seen_path"]) & judged["safe"], "full_outer")
    unsafe = ~F.coalesce("safe", F.lit(True))
    kind = F.when(unsafe, "unsafe_entry").when(F.col("seen").isNull(), "missing_file").when(F.col("said").isNull(), "orphan_file").when(~F.col("said").eqNullSafe(F.col("seen")), "invalid_file")
    path = F.when(~unsafe, F.coalesce("relative_path", "seen_path"))
    return j.select(kind.alias("kind"), path.alias("relative_path"), "artifact_id", F.when(unsafe, F.sha2("seen_path", 256)).alias("entry_sha256")).filter("kind is not null")


def artifact_report(manifests: DataFrame, files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: manifests, files, verified manifests, issues of each kind, and the digest over all three sets."""
    counts = issues.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ISSUE_KINDS])
    m, f = manifests.agg(F.count("*").alias("manifest_count")), files.agg(F.count("*").alias("file_count"))
    one = F.lit(1).alias("one")
    row = counts.select("*", one).join(m.select("*", one), "one").join(f.select("*", one), "one").join(inventory_digest(manifests, files, issues).select("*", one), "one").drop("one")
    return row.withColumn("verified_count", F.col("manifest_count") - F.col("missing_file") - F.col("invalid_file"))


def artifact_contents(found: DataFrame, manifests: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """relative_path, kind, said, told for Parquet files that aren't what their manifests say: row_count, schema, unreadable, missing_file, orphan_file.

    found: what the files' own footers say (sources.footers). A file can be told for its rows and for its columns.
    """
    wanted = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) if schema else None
    columns = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["type"])), ", ")
    f = found.select("relative_path", F.col("row_count").alias("rows"), columns.alias("columns"), "error", F.lit(True).alias("there"))
    j = manifests.select("relative_path", "row_count", F.lit(True).alias("known")).join(f, "relative_path", "full_outer")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    tell = lambda when, kind, said, told: F.when(when, F.struct(F.lit(kind).alias("kind"), said.alias("said"), told.alias("told")))
    both = F.col("known").isNotNull() & F.col("there").isNotNull()
    kinds = [
        tell(F.col("there").isNull(), "missing_file", text("row_count"), none),
        tell(F.col("known").isNull(), "orphan_file", none, text("rows")),
        tell(both & F.col("error").isNotNull(), "unreadable", text("row_count"), F.col("error")),
        tell(both & F.col("error").isNull() & ~F.col("row_count").eqNullSafe(F.col("rows")), "row_count", text("row_count"), text("rows")),
    ]
    if wanted:
        kinds.append(tell(both & (F.col("columns") != wanted), "schema", F.lit(wanted), F.col("columns")))
    return j.select("relative_path", F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("relative_path", "x.*")
