"""Keyset pages and exact lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The listings of the data model and their orders.
LISTINGS: dict[str, tuple[str, ...]] = {
    "pipelines": ("pipeline_id",),
    "pipeline_versions": ("version_number",),
    "connectors": ("connector_id",),
    "runs": ("run_id",),
    "run_nodes": ("node_id",),
    "work_items": ("work_item_id",),
    "work_attempts": ("attempt_number",),
    "checkpoints": ("version",),
    "execution_events": ("sequence_number",),
    "idempotency_records": ("created_at", "scope", "idempotency_key"),
    "repair_plans": ("created_at", "repair_plan_id"),
    "repair_actions": ("canonical_key", "repair_action_id"),
    "audit_entries": ("sequence_number",),
    "artifact_manifests": ("artifact_id",),
    "outcomes": ("sku",),
    "node_statistics": ("node_id",),
}


def after_cursor(df: DataFrame, order: list[str], after: tuple | None) -> DataFrame:
    """The rows that come after the cursor in lexicographic order; the filter reaches the scan for the first column."""
    if after is None:
        return df
    if len(after) != len(order):
        raise ValueError("the cursor needs a value for each order column")
    equal, parts = F.lit(True), []
    for c, v in zip(order, after):
        parts.append(equal & (F.col(c) > F.lit(v)))
        equal = equal & (F.col(c) == F.lit(v))
    return df.filter(F.col(order[0]) >= F.lit(after[0])).filter(reduce(lambda a, b: a | b, parts))


def ordered_blocks(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """df with ``block``: a key's rows in order, in blocks of at most limit rows whose numbers grow with the order (not one by one).

    A key within the limit is one block, 0. Longer ones are sorted over many tasks and cut where a task's share or the limit ends, so
    no group is any single task's work and none is left out.
    """
    long = df.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > limit).select(*keys)
    short = df.join(long, keys, "left_anti").withColumn("block", F.lit(0).cast("long"))
    place = F.monotonically_increasing_id()  # task number and row within the task, as the sort below leaves them
    dealt = df.join(long, keys, "left_semi").orderBy(*keys, *order).withColumn("place_", place)
    row = F.col("place_").bitwiseAND(F.lit((1 << 33) - 1))
    return short.unionByName(dealt.withColumn("block", F.col("place_") - row % limit).drop("place_"))


def page_frame(df: DataFrame, order: list[str], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """At most limit + 1 rows after the cursor, in order; the extra row only tells that there is a next page."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    return after_cursor(df, order, after).orderBy(*order).limit(limit + 1)


def page(df: DataFrame, order: list[str], after: tuple | None = None, limit: int = 100) -> tuple[list[Row], tuple | None]:
    """(rows, next cursor); the cursor is None on the last page."""
    rows = page_frame(df, order, after, limit).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, tuple(rows[-1][c] for c in order) if more else None


def listing(df: DataFrame, name: str, after: tuple | None = None, limit: int = 100, where: str | None = None) -> tuple[list[Row], tuple | None]:
    """A page of one of LISTINGS; where narrows it (one run, one state, without archived rows)."""
    return page(df.filter(where) if where else df, list(LISTINGS[name]), after, limit)


def audit_match(audits: DataFrame, facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """facts with matches (how many audit rows agree on all identity columns) and verdict: missing, unique or ambiguous. Nulls agree with nulls."""
    keys = keys or [c for c in facts.columns if c in audits.columns]
    n = audits.groupBy(*keys).agg(F.count("*").alias("matches"))
    a, b = facts.alias("a"), n.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    found = a.join(b, same, "left").select("a.*", F.coalesce("b.matches", F.lit(0)).alias("matches"))
    return found.withColumn("verdict", F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "unique").otherwise("ambiguous"))
