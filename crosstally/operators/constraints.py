"""The data model's own constraints, declared once and checked over whole tables: row rules, unique keys, foreign keys.

A rule is a name, the columns that it is about and a condition; it holds where the condition isn't false, so a null that a rule says nothing of
passes, as with a database's checks. All rules of a table are one expression over one scan; rules about columns that a table lacks are left out.
Keys are those of schemas.UNIQUE_KEYS and FOREIGN_KEYS, for the tables that are given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLASSES, DISPOSITIONS, FOREIGN_KEYS, ID_PREFIXES, MAX_DURATION, MAX_NUMBER, NODE_STATES, OUTCOME_OF_STATE, RUN_TRANSITIONS, UNIQUE_KEYS, WORK_TRANSITIONS, terminal
from .history import check_foreign_keys, check_unique


@dataclass(frozen=True)
class Rule:
    name: str
    columns: tuple[str, ...]
    holds: Callable[..., Column]

    def condition(self) -> Column:
        return self.holds(*[F.col(c) for c in self.columns])


def present(*columns: str) -> list[Rule]:
    return [Rule(f"{c}_present", (c,), lambda x: x.isNotNull()) for c in columns]


def identifier(column: str, kind: str) -> Rule:
    """The kind's prefix, then 3 to 64 small letters, digits and single hyphens inside."""
    shape = rf"\A{ID_PREFIXES[kind]}_(?=.{{3,64}}\z)[a-z0-9]+(-[a-z0-9]+)*\z"
    return Rule(f"{column}_shape", (column,), lambda x: x.rlike(shape))


def among(column: str, values: Iterable[str]) -> Rule:
    known = list(values)
    return Rule(f"{column}_values", (column,), lambda x: x.isin(*known))


def within(column: str, low: int, high: int | None = None) -> Rule:
    return Rule(f"{column}_range", (column,), lambda x: x.between(low, high) if high is not None else x >= low)


def sized(column: str, most: int) -> Rule:
    return Rule(f"{column}_size", (column,), lambda x: F.length(x).between(1, most))


def digest(column: str) -> Rule:
    return Rule(f"{column}_shape", (column,), lambda x: x.rlike(r"\A[0-9a-f]{64}\z"))


def ordered(first: str, then: str) -> Rule:
    return Rule(f"{then}_order", (first, then), lambda a, b: b >= a)


def json_kind(column: str, kind: str) -> Rule:
    """A JSON text that is an object, or an array."""
    first, last = {"object": "{}", "array": "[]"}[kind]  # the parser lets signs behind a value pass
    return Rule(f"{column}_{kind}", (column,), lambda x: x.isNull() | F.try_parse_json(x).isNotNull() & F.trim(x).startswith(first) & F.trim(x).endswith(last))


def _all_or_none(when: Column, *columns: Column) -> Column:
    """All columns are there where ``when`` holds, and none elsewhere."""
    there = [c.isNotNull() for c in columns]
    return F.when(when, reduce(lambda a, b: a & b, there)).otherwise(~reduce(lambda a, b: a | b, there))


_BUCKETS = tuple(f"work_{b}" for b in ("pending", "running", "succeeded", "quarantined", "failed", "cancelled"))
_COUNTS = ("work_total", *_BUCKETS, "records_read", "records_written", "records_quarantined", "bytes_read", "bytes_written", "retry_count")
_ENDED_WELL = ("succeeded", "partially_succeeded")

RULES: dict[str, list[Rule]] = {
    "runs": [
        *present("run_id", "state", "created_at"),
        identifier("run_id", "run"),
        among("state", RUN_TRANSITIONS),
        within("row_version", 1, MAX_NUMBER),
        digest("plan_fingerprint"),
        digest("final_fingerprint"),
        json_kind("runner_configuration_json", "object"),
        ordered("created_at", "started_at"),
        ordered("created_at", "finished_at"),
        Rule("terminal_finish", ("state", "finished_at"), lambda s, f: ~s.isin(*terminal(RUN_TRANSITIONS)) | f.isNotNull()),
        Rule("final_fingerprint_terminal", ("state", "final_fingerprint"), lambda s, f: f.isNull() | s.isin(*_ENDED_WELL)),
    ],
    "run_event_counters": [*present("run_id", "next_sequence"), within("next_sequence", 1, MAX_NUMBER), within("row_version", 1, MAX_NUMBER)],
    "run_nodes": [
        *present("run_id", "node_id", "status", *_COUNTS),
        identifier("node_id", "node"),
        among("status", NODE_STATES),
        within("row_version", 1, MAX_NUMBER),
        *[within(c, 0) for c in _COUNTS],
        within("duration_microseconds", 0, MAX_DURATION),
        Rule("work_count_sum", ("work_total", *_BUCKETS), lambda total, *parts: reduce(lambda a, b: a + b, parts) <= total),
    ],
    "work_items": [
        *present("work_item_id", "run_id", "node_id", "partition_key", "state"),
        identifier("work_item_id", "work_item"),
        sized("partition_key", 128),
        among("state", [s for s in WORK_TRANSITIONS if s != "leased"]),
        within("row_version", 1, MAX_NUMBER),
        within("completed_attempt_count", 0, MAX_NUMBER),
        within("expected_checkpoint_version", 0, MAX_NUMBER),
        json_kind("input_reference_json", "object"),
        sized("lease_owner", 128),
        Rule("active_attempt", ("state", "lease_owner", "lease_expires_at", "active_attempt_number", "active_attempt_started_at"), lambda s, *held: _all_or_none(s == "running", *held)),
        Rule("active_attempt_number_order", ("active_attempt_number", "completed_attempt_count"), lambda n, done: n == done + 1),
        Rule("lease_time_order", ("active_attempt_started_at", "lease_expires_at"), lambda a, b: b > a),
        Rule("retry_time", ("state", "available_at"), lambda s, at: _all_or_none(s == "retry_wait", at)),
    ],
    "work_attempts": [
        *present("work_item_id", "attempt_number", "outcome", "started_at", "finished_at"),
        within("attempt_number", 1, MAX_NUMBER),
        among("outcome", [*dict.fromkeys(OUTCOME_OF_STATE.values()), "lease_expired"]),
        among("failure_class", DISPOSITIONS),
        json_kind("result_reference_json", "object"),
        within("duration_microseconds", 0, MAX_DURATION),
        ordered("started_at", "finished_at"),
        Rule("failure", ("outcome", "failure_class"), lambda o, f: (o == "succeeded") == f.isNull()),
        Rule("lease_expired_class", ("outcome", "failure_class"), lambda o, f: (o != "lease_expired") | f.eqNullSafe(F.lit("timeout"))),
    ],
    "artifact_manifests": [
        *present("artifact_id", "run_id", "node_id", "partition_key", "relative_path", "sha256"),
        identifier("artifact_id", "artifact"),
        sized("partition_key", 128),
        Rule("relative_path_basic", ("relative_path",), lambda p: F.length(p).between(1, 1024) & ~p.rlike(r"\A[/\\]|\x00")),
        sized("media_type", 127),
        within("schema_version", 1, MAX_NUMBER),
        within("byte_size", 0),
        within("row_count", 0),
        digest("sha256"),
    ],
    "checkpoint_heads": [*present("run_id", "node_id", "partition_key", "version"), within("version", 0, MAX_NUMBER)],
    "checkpoints": [*present("run_id", "node_id", "partition_key", "version"), within("version", 1, MAX_NUMBER), json_kind("source_cursor_json", "object"), json_kind("output_position_json", "object")],
    "execution_events": [*present("run_id", "sequence_number", "kind", "subject_kind", "occurred_at"), within("sequence_number", 1, MAX_NUMBER), sized("kind", 96), sized("subject_kind", 48), sized("subject_id", 128), json_kind("payload_json", "object")],
    "idempotency_records": [
        *present("scope", "idempotency_key", "request_sha256", "status"),
        sized("scope", 96),
        sized("idempotency_key", 128),
        digest("request_sha256"),
        among("status", ("in_progress", "completed", "failed")),
        json_kind("response_json", "object"),
        Rule("result", ("status", "result_sha256"), lambda s, r: _all_or_none(s != "in_progress", r)),
    ],
    "reconciliation_summaries": [*present("run_id", "classification", "n"), among("classification", CLASSES), within("n", 0)],
    "reconciliation_conflicts": [
        *present("conflict_id", "run_id", "canonical_key", "classification"),
        identifier("conflict_id", "conflict"),
        sized("canonical_key", 64),
        among("classification", [c for c in CLASSES if c != "match"]),
        sized("suggested_action", 32),
        json_kind("field_differences_json", "array"),
    ],
    "repair_plans": [
        *present("repair_plan_id", "run_id", "status"),
        identifier("repair_plan_id", "repair_plan"),
        digest("state_fingerprint"),
        digest("content_fingerprint"),
        among("status", ("proposed", "approved", "applying", "applied", "rejected", "failed")),
    ],
    "repair_approvals": [*present("repair_plan_id", "state_fingerprint", "approver", "approved_at"), digest("state_fingerprint"), sized("approver", 128)],
    "repair_actions": [
        *present("repair_action_id", "repair_plan_id", "conflict_id", "canonical_key", "kind", "status", "after_sha256", "external_idempotency_key"),
        identifier("repair_action_id", "repair_action"),
        sized("canonical_key", 64),
        sized("external_idempotency_key", 128),
        among("kind", ("create_target", "update_target")),
        among("status", ("pending", "applied", "failed")),
        digest("before_sha256"),
        digest("after_sha256"),
        Rule("action_shape", ("kind", "before_sha256"), lambda k, b: (k == "update_target") == b.isNotNull()),
    ],
    "audit_entries": [*present("sequence_number", "actor", "action", "occurred_at"), within("sequence_number", 1, MAX_NUMBER), sized("actor", 128), sized("action", 96), sized("object_id", 128), sized("correlation_id", 96)],
}

#: The columns that name a row of each table: its first unique key.
NAMED_BY = {name: columns for name, columns in reversed(UNIQUE_KEYS)}


def rules_of(name: str, df: DataFrame) -> list[Rule]:
    """The declared rules of a table that are about columns it has."""
    return [r for r in RULES.get(name, []) if set(r.columns) <= set(df.columns)]


def check_rows(name: str, df: DataFrame) -> DataFrame:
    """table, id, rule of the rows that break a declared rule; one scan."""
    broken = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(~r.condition(), F.lit(r.name)) for r in rules_of(name, df)]))
    ident = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in NAMED_BY[name]])
    return df.select(F.lit(name).alias("table"), ident.alias("id"), F.explode(broken).alias("rule"))


def check_model(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, id, rule of everything in the given tables that the data model forbids: broken row rules, keys that several rows have, keys that refer to nothing."""
    found = [check_rows(name, df) for name, df in tables.items() if name in RULES]
    key = lambda df, what: df.select("table", F.col("value").alias("id"), F.concat(F.lit(f"{what}:"), "columns").alias("rule"))
    if any(k[0] in tables for k in UNIQUE_KEYS):
        found.append(key(check_unique(tables, UNIQUE_KEYS), "unique"))
    if any(k[0] in tables and k[2] in tables for k in FOREIGN_KEYS):
        found.append(key(check_foreign_keys(tables, FOREIGN_KEYS), "foreign"))
    return reduce(DataFrame.unionByName, found)
