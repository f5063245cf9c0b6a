"""Schemas, closed value sets and transition tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "tinyint": T.ByteType(), "timestamp": T.TimestampType(), "attributes": T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))}


def _struct(columns: str) -> T.StructType:
    """A schema from ``name type, name type``; made without a session, as Python workers import this module too."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split(" ") for c in columns.split(", "))])


RAW_SCHEMA = _struct("record_index long, connector_id string, source_record_key string, captured_at timestamp, payload_json string")
NORMALIZED_SCHEMA = _struct("record_index long, sku string, name string, quantity int, unit_price_minor_units long, unit_price_currency string, unit_price_exponent tinyint, updated_at timestamp, connector_id string, source_record_key string, attributes attributes")
#: Business fields in the order in which differences are told.
FIELDS = ("name", "quantity", "unit_price", "updated_at", "attributes")
PRICE = ("unit_price_minor_units", "unit_price_currency", "unit_price_exponent")

_OPS = {
    "runs": "run_id string, state string, row_version int, plan_fingerprint string, created_at timestamp, started_at timestamp, finished_at timestamp",
    "run_event_counters": "run_id string, next_sequence long, row_version int",
    "run_nodes": "run_id string, node_id string, status string, row_version int, work_total long, work_pending long, work_running long, work_succeeded long, work_quarantined long, work_failed long, work_cancelled long, records_read long, records_written long, records_quarantined long, bytes_read long, bytes_written long, retry_count long, duration_microseconds long, started_at timestamp, finished_at timestamp",
    "work_items": "work_item_id string, run_id string, node_id string, partition_key string, state string, row_version int, completed_attempt_count int, active_attempt_number int, active_attempt_started_at timestamp, lease_owner string, lease_expires_at timestamp, available_at timestamp, expected_checkpoint_version long",
    "work_attempts": "work_item_id string, run_id string, node_id string, attempt_number int, outcome string, failure_class string, duration_microseconds long, started_at timestamp, finished_at timestamp",
    "artifact_manifests": "artifact_id string, run_id string, node_id string, partition_key string, relative_path string, media_type string, schema_version int, row_count long, byte_size long, sha256 string, created_at timestamp",
    "checkpoint_heads": "run_id string, node_id string, partition_key string, version long",
    "checkpoints": "run_id string, node_id string, partition_key string, version long, artifact_id string, created_at timestamp",
    "execution_events": "run_id string, sequence_number long, kind string, subject_kind string, subject_id string, occurred_at timestamp",
    "idempotency_records": "scope string, idempotency_key string, request_sha256 string, status string, result_sha256 string, created_at timestamp",
    "reconciliation_summaries": "run_id string, classification string, n long",
    "reconciliation_conflicts": "conflict_id string, run_id string, canonical_key string, classification string, suggested_action string",
    "repair_plans": "repair_plan_id string, run_id string, state_fingerprint string, content_fingerprint string, status string, created_at timestamp",
    "repair_approvals": "repair_plan_id string, state_fingerprint string, approver string, approved_at timestamp",
    "repair_actions": "repair_action_id string, repair_plan_id string, conflict_id string, canonical_key string, kind string, status string, before_sha256 string, after_sha256 string, external_idempotency_key string",
    "audit_entries": "sequence_number long, correlation_id string, actor string, action string, object_id string, occurred_at timestamp",
}
OPS_SCHEMAS = {k: _struct(v) for k, v in _OPS.items()}

# Closed sets of the data model.
CLASSES = ("match", "field_mismatch", "missing_from_target", "missing_from_source", "duplicate_source", "duplicate_target", "duplicate_both")
REPAIRABLE = ("missing_from_target", "field_mismatch")
RUN_TRANSITIONS = {
    "queued": ("running", "cancelled"),
    "running": ("pausing", "succeeded", "partially_succeeded", "failed", "cancelling"),
    "pausing": ("paused",),
    "paused": ("resuming",),
    "resuming": ("running",),
    "cancelling": ("cancelled",),
    "succeeded": (),
    "partially_succeeded": (),
    "failed": (),
    "cancelled": (),
}
WORK_TRANSITIONS = {
    "pending": ("leased",),
    "leased": ("running",),
    "running": ("succeeded", "retry_wait", "quarantined", "failed", "cancelled"),
    "retry_wait": ("leased",),
    "succeeded": (),
    "quarantined": (),
    "failed": (),
    "cancelled": (),
}
NODE_STATES = ("pending", "running", "succeeded", "partially_succeeded", "failed", "cancelled")
OUTCOME_OF_STATE = {"succeeded": "succeeded", "retry_wait": "retry_scheduled", "quarantined": "quarantined", "failed": "failed", "cancelled": "cancelled"}
DISPOSITIONS = {
    "connection": "retry",
    "timeout": "retry",
    "http_429": "retry",
    "http_5xx": "retry",
    "http_4xx": "permanent",
    "validation": "quarantine",
    "idempotency_conflict": "conflict",
    "sqlite_contention": "retry",
    "user_cancellation": "cancel",
    "unknown": "permanent",
}
ID_PREFIXES = {"pipeline": "pip", "node": "nod", "connector": "con", "run": "run", "work_item": "wrk", "artifact": "art", "conflict": "cnf", "repair_plan": "rpl", "repair_action": "rac"}
SENSITIVE_PARTS = ("access_key", "api_key", "authorization", "bearer", "cookie", "credential", "password", "private_key", "secret", "session", "token")
FOREIGN_KEYS = (
    ("run_event_counters", ("run_id",), "runs", ("run_id",)),
    ("run_nodes", ("run_id",), "runs", ("run_id",)),
    ("work_items", ("run_id", "node_id"), "run_nodes", ("run_id", "node_id")),
    ("work_attempts", ("work_item_id",), "work_items", ("work_item_id",)),
    ("artifact_manifests", ("run_id", "node_id"), "run_nodes", ("run_id", "node_id")),
    ("checkpoint_heads", ("run_id", "node_id", "partition_key"), "work_items", ("run_id", "node_id", "partition_key")),
    ("checkpoints", ("run_id", "node_id", "partition_key"), "checkpoint_heads", ("run_id", "node_id", "partition_key")),
    ("checkpoints", ("artifact_id", "run_id", "node_id", "partition_key"), "artifact_manifests", ("artifact_id", "run_id", "node_id", "partition_key")),
    ("execution_events", ("run_id",), "runs", ("run_id",)),
    ("reconciliation_summaries", ("run_id",), "runs", ("run_id",)),
    ("reconciliation_conflicts", ("run_id",), "runs", ("run_id",)),
    ("repair_plans", ("run_id",), "runs", ("run_id",)),
    ("repair_approvals", ("repair_plan_id", "state_fingerprint"), "repair_plans", ("repair_plan_id", "state_fingerprint")),
    ("repair_actions", ("repair_plan_id",), "repair_plans", ("repair_plan_id",)),
    ("repair_actions", ("conflict_id", "canonical_key"), "reconciliation_conflicts", ("conflict_id", "canonical_key")),
)
UNIQUE_KEYS = (
    ("runs", ("run_id",)),
    ("run_event_counters", ("run_id",)),
    ("run_nodes", ("run_id", "node_id")),
    ("work_items", ("work_item_id",)),
    ("work_items", ("run_id", "node_id", "partition_key")),
    ("work_attempts", ("work_item_id", "attempt_number")),
    ("artifact_manifests", ("artifact_id",)),
    ("artifact_manifests", ("relative_path",)),
    ("checkpoint_heads", ("run_id", "node_id", "partition_key")),
    ("checkpoints", ("run_id", "node_id", "partition_key", "version")),
    ("execution_events", ("run_id", "sequence_number")),
    ("idempotency_records", ("scope", "idempotency_key")),
    ("reconciliation_summaries", ("run_id", "classification")),
    ("reconciliation_conflicts", ("conflict_id",)),
    ("reconciliation_conflicts", ("run_id", "canonical_key")),
    ("repair_plans", ("repair_plan_id",)),
    ("repair_plans", ("run_id", "content_fingerprint")),
    ("repair_approvals", ("repair_plan_id",)),
    ("repair_actions", ("repair_action_id",)),
    ("repair_actions", ("external_idempotency_key",)),
    ("repair_actions", ("repair_plan_id", "canonical_key", "kind")),
    ("audit_entries", ("sequence_number",)),
)
#: The largest number of a sequence or version, and the longest duration in microseconds.
MAX_NUMBER, MAX_DURATION = 2_147_483_647, 31_536_000_000_000


def terminal(transitions: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The states that nothing leaves."""
    return tuple(k for k, v in transitions.items() if not v)


def transition_table(spark: SparkSession, transitions: dict[str, tuple[str, ...]]) -> DataFrame:
    """from_state, to_state of every legal move."""
    return spark.createDataFrame([(a, b) for a, to in transitions.items() for b in to], "from_state string, to_state string")


def require_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df, if its columns have exactly the expected names, types and order; else an error."""
    found, wanted = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in expected]
    if found != wanted:
        raise ValueError(f"schema is {found}, not {wanted}")
    return df


def null_violations(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, n of each column that has nulls (empty: none). One pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names]))
    return counts.select(pairs.alias("p")).select("p.*").filter("n > 0")


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises if a check found something; the message has the first rows."""
    if rows := violations.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
