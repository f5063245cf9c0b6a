"""Idempotency records, retries, leases and recovery findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DISPOSITIONS, RUN_TRANSITIONS, WORK_TRANSITIONS, terminal
from .runstats import aggregate_drift

# The retry policy, in microseconds.
MAX_ATTEMPTS = 3
STANDARD = (1_000_000, 60_000_000)
CONTENTION = (10_000, 1_000_000)
MAX_429_DELAY = 86_400_000_000
JITTER_DIVISOR = 4

# Severities of findings, mildest first, and the kinds that are more than healthy.
SEVERITIES = ("healthy", "active", "recoverable", "ambiguous")
SEVERITY_OF = {
    "work_active_lease": "active",
    "work_expired_no_effect": "recoverable",
    "work_expired_with_committed_artifact": "ambiguous",
    "work_running_without_lease": "ambiguous",
    "run_terminal_with_active_work": "ambiguous",
    "checkpoint_frontier_mismatch": "ambiguous",
    "attempt_history_mismatch": "ambiguous",
    "aggregate_mismatch": "ambiguous",
    "event_frontier_corrupt": "ambiguous",
    "integrity_missing_file": "ambiguous",
    "integrity_orphan_file": "ambiguous",
    "integrity_changed_file": "ambiguous",
    "integrity_invalid_file": "ambiguous",
    "integrity_unsafe_entry": "ambiguous",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


# --- idempotency


def request_digest(document: Column) -> Column:
    """Digest of a canonical document text."""
    return F.sha2(document, 256)


def idempotency_begin(records: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (scope, idempotency_key, request_sha256, created_at) with disposition.

    started for the first request of an unknown key; in_progress_replay, completed_replay or failed_replay for the same request again;
    conflict for another request under the same key, be the first stored or earlier in this batch.
    """
    keys = ["scope", "idempotency_key"]
    first = requests.groupBy(*keys).agg(F.min(F.struct("created_at", "request_sha256")).alias("first"))
    known = records.select(*keys, F.col("request_sha256").alias("stored_sha256"), F.col("status").alias("stored_status"))
    j = requests.join(first, keys).join(known, keys, "left")
    # only requests of one moment are numbered, so a key that is asked for very often is no single task's sort
    one = F.row_number().over(Window.partitionBy(*keys, "request_sha256", "created_at").orderBy("created_at"))
    earliest = (one == 1) & (F.col("created_at") == F.col("first.created_at"))
    j = j.withColumn("earliest", earliest)
    reference = F.coalesce("stored_sha256", "first.request_sha256")
    replay = F.concat(F.coalesce("stored_status", F.lit("in_progress")), F.lit("_replay"))
    d = F.when(F.col("request_sha256") != reference, "conflict").when(F.col("stored_sha256").isNull() & F.col("earliest"), "started").otherwise(replay)
    return j.select(*requests.columns, d.alias("disposition"))


def idempotency_complete(records: DataFrame, results: DataFrame) -> DataFrame:
    """results (scope, idempotency_key, status, result_sha256) with verdict: completed, replay, conflict or unknown."""
    keys = ["scope", "idempotency_key"]
    known = records.select(*keys, F.col("status").alias("stored_status"), F.col("result_sha256").alias("stored_result"))
    j = results.join(known, keys, "left")
    same = F.col("status").eqNullSafe(F.col("stored_status")) & F.col("result_sha256").eqNullSafe(F.col("stored_result"))
    v = F.when(F.col("stored_status").isNull(), "unknown").when(F.col("stored_status") == "in_progress", "completed").when(same, "replay").otherwise("conflict")
    return j.select(*results.columns, v.alias("verdict"))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing and the incoming rows whose key it lacks; of incoming rows with one key the smallest is taken."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*")
    return existing.unionByName(one.join(existing.select(*keys), list(keys), "left_anti"))


def cas_update(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(updated table, stale changes). A change names the version it expects; it applies only to that one, which then grows by one."""
    cols = [c for c in changes.columns if c not in (*keys, version)]
    c = changes.select(*keys, F.col(version).alias("expected"), F.struct(*cols).alias("new"))
    j = current.join(c, list(keys), "left")
    hit = F.coalesce(F.col("expected") == F.col(version), F.lit(False))
    out = [F.when(hit, F.col(f"new.{x}")).otherwise(F.col(x)).alias(x) if x in cols else F.when(hit, F.col(x) + 1).otherwise(F.col(x)).alias(x) if x == version else F.col(x) for x in current.columns]
    now = current.select(*keys, F.col(version).alias("found"))
    stale = changes.join(now, list(keys), "left").filter(~F.col(version).eqNullSafe(F.col("found")))
    return j.select(*out), stale


# --- retries and leases


def failure_disposition(failure: Column) -> Column:
    return _lookup(DISPOSITIONS, failure)


def retry_schedule(failures: DataFrame, seed: int) -> DataFrame:
    """failures (work_item_id, failure_class, attempt_number, observed_at, http_429_delay) with disposition, base, jitter, delay and available_at.

    The base doubles with each attempt up to a cap; a 429 answer's own delay is a lower bound. Jitter is at most a quarter of the base,
    drawn from a digest of seed, work item, class, attempt and bound. The third attempt is the last.
    """
    c = F.col
    contention = c("failure_class") == "sqlite_contention"
    initial, cap = F.when(contention, CONTENTION[0]).otherwise(STANDARD[0]), F.when(contention, CONTENTION[1]).otherwise(STANDARD[1])
    asked = F.when(c("failure_class") == "http_429", c("http_429_delay"))
    exponent = F.least(c("attempt_number"), F.lit(MAX_ATTEMPTS)) - 1
    base = F.greatest(F.least(cap.cast("long"), initial.cast("long") * F.pow(F.lit(2), exponent).cast("long")), asked)
    overall = F.when(asked.isNotNull(), F.lit(MAX_429_DELAY)).otherwise(cap.cast("long"))
    bound = F.least(overall - base, F.floor(base / JITTER_DIVISOR))
    digest = F.sha2(F.concat_ws("|", F.lit("retry-jitter-v1"), F.lit(seed).cast("string"), "work_item_id", "failure_class", c("attempt_number").cast("string"), bound.cast("string")), 256)
    jitter = (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % (bound + 1).cast("decimal(20,0)")).cast("long")
    retry = (failure_disposition(c("failure_class")) == "retry") & (c("attempt_number") < MAX_ATTEMPTS)
    disposition = F.when(failure_disposition(c("failure_class")) != "retry", failure_disposition(c("failure_class"))).when(c("attempt_number") >= MAX_ATTEMPTS, "permanent").otherwise("retry")
    out = failures.withColumn("disposition", disposition).withColumn("base_microseconds", F.when(retry, base)).withColumn("jitter_microseconds", F.when(retry, jitter))
    out = out.withColumn("delay_microseconds", F.col("base_microseconds") + F.col("jitter_microseconds"))
    return out.withColumn("available_at", F.timestamp_micros(F.unix_micros("observed_at") + F.col("delay_microseconds")))


def claimable(work: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Work items of running runs that are pending or whose wait is over."""
    due = (F.col("state") == "pending") | (F.col("state") == "retry_wait") & (F.col("available_at") <= now)
    return work.filter(due).join(runs.filter("state = 'running'").select("run_id"), "run_id", "left_semi")


def expired_leases(work: DataFrame, now: Column) -> DataFrame:
    return work.filter(F.col("state").isin("leased", "running") & (F.col("lease_expires_at") <= now))


def recover_expired(work: DataFrame, now: Column, retry_at: Column) -> tuple[DataFrame, DataFrame]:
    """(attempt rows, work rows): each expired lease ends its attempt as lease_expired and sends its work item to retry_wait."""
    gone = expired_leases(work, now)
    began = F.coalesce("available_at", "lease_expires_at")
    attempts = gone.select("work_item_id", "run_id", "node_id", F.col("active_attempt_number").alias("attempt_number"), F.lit("lease_expired").alias("outcome"), F.lit("timeout").alias("failure_class"), (F.unix_micros(now) - F.unix_micros(began)).alias("duration_microseconds"), began.alias("started_at"), now.alias("finished_at"))
    change = {"state": F.lit("retry_wait"), "completed_attempt_count": F.col("completed_attempt_count") + 1, "active_attempt_number": F.lit(None).cast("int"), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp"), "available_at": retry_at, "row_version": F.col("row_version") + 1}
    return attempts, gone.select(*[change[c].alias(c) if c in change else F.col(c) for c in work.columns])


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """outcome, failure_class, disposition, n, total, shortest and longest duration."""
    g = attempts.groupBy("outcome", "failure_class").agg(F.count("*").alias("n"), F.sum("duration_microseconds").alias("total_microseconds"), F.min("duration_microseconds").alias("min_microseconds"), F.max("duration_microseconds").alias("max_microseconds"))
    return g.withColumn("disposition", failure_disposition(F.col("failure_class")))


# --- recovery


def work_findings(work: DataFrame, attempts: DataFrame, heads: DataFrame, manifests: DataFrame, now: Column) -> DataFrame:
    """run_id, node_id, work_item_id, kind: all that each work item's row and its history tell."""
    keys = ["run_id", "node_id", "partition_key"]
    n = attempts.groupBy("work_item_id").agg(F.count("*").alias("n_attempts"))
    made = manifests.select(*keys).distinct().withColumn("has_artifact", F.lit(True))
    f = work.join(heads.select(*keys, F.col("version").alias("head")), keys, "left").join(made, keys, "left").join(n, "work_item_id", "left")
    state, head = F.col("state"), F.col("head")
    running = state == "running"
    no_lease = F.col("lease_expires_at").isNull() | F.col("active_attempt_number").isNull()
    expired = running & ~no_lease & (F.col("lease_expires_at") <= now)
    settled = ~state.isin("pending", "retry_wait", "running")
    kinds = [
        F.when(~head.eqNullSafe(F.col("expected_checkpoint_version")) | head.isNull(), "checkpoint_frontier_mismatch"),
        F.when(F.coalesce("n_attempts", F.lit(0)) != F.col("completed_attempt_count"), "attempt_history_mismatch"),
        F.when(state == "pending", "work_pending"),
        F.when(state == "retry_wait", "work_retry_waiting"),
        F.when(running & no_lease, "work_running_without_lease"),
        F.when(running & ~no_lease & (F.col("lease_expires_at") > now), "work_active_lease"),
        F.when(expired & (F.coalesce(head, F.lit(0)) >= 1), "checkpoint_frontier_mismatch"),
        F.when(expired & (F.coalesce(head, F.lit(0)) < 1) & F.col("has_artifact"), "work_expired_with_committed_artifact"),
        F.when(expired & (F.coalesce(head, F.lit(0)) < 1) & F.col("has_artifact").isNull(), "work_expired_no_effect"),
        F.when(settled & (state == "succeeded") & (F.coalesce(head, F.lit(0)) < 1), "checkpoint_frontier_mismatch"),
        F.when(settled, "work_committed"),
    ]
    return f.select("run_id", "node_id", "work_item_id", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def run_findings(runs: DataFrame, nodes: DataFrame, work: DataFrame) -> DataFrame:
    """run_id, kind: what each run's state tells."""
    done = terminal(WORK_TRANSITIONS)
    w = work.groupBy("run_id").agg(F.bool_or(F.col("state") == "running").alias("has_running"), F.bool_or(~F.col("state").isin(*done)).alias("has_open"))
    n = nodes.groupBy("run_id").agg(F.bool_or(F.col("status").isin("pending", "running")).alias("open_node"))
    f = runs.join(w, "run_id", "left").join(n, "run_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    active = F.when(F.col("state") == "cancelled", yes("has_running")).otherwise(yes("has_open") | yes("open_node"))
    ended = F.col("state").isin(*terminal(RUN_TRANSITIONS))
    kind = F.when(ended & active, "run_terminal_with_active_work").when(ended, "run_terminal").when(F.col("state") == "queued", "run_queued").when(F.col("state").isin("pausing", "paused", "resuming"), "run_paused")
    return f.select("run_id", kind.alias("kind")).filter("kind is not null")


# Findings for the kinds of issues that a scan of files tells.
INTEGRITY = {"missing_file": "integrity_missing_file", "orphan_file": "integrity_orphan_file", "invalid_file": "integrity_changed_file", "changed_file": "integrity_changed_file", "unsafe_entry": "integrity_unsafe_entry"}


def recovery_findings(runs: DataFrame, nodes: DataFrame, work: DataFrame, attempts: DataFrame, heads: DataFrame, manifests: DataFrame, issues: DataFrame, idempotency: DataFrame, now: Column) -> DataFrame:
    """run_id, node_id, work_item_id, artifact_id, kind, severity, of 21 kinds. issues (kind, artifact_id, relative_path) belong to no run.

    A scan tells a file of other size or digest as invalid; to recovery it is a changed file.
    """
    shape = ["run_id", "node_id", "work_item_id", "artifact_id", "kind"]
    full = lambda df: df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in shape])
    drifted = aggregate_drift(nodes, work, attempts).select("run_id").distinct().withColumn("kind", F.lit("aggregate_mismatch"))
    files = issues.select(_lookup(INTEGRITY, F.col("kind")).alias("kind"), "artifact_id").filter("kind is not null")
    held = idempotency.filter("status = 'in_progress'").select(F.lit("stranded_idempotency").alias("kind"))
    corrupt = idempotency.filter("status not in ('in_progress', 'completed', 'failed')").select(F.lit("event_frontier_corrupt").alias("kind"))
    parts = [work_findings(work, attempts, heads, manifests, now), run_findings(runs, nodes, work), drifted, files, held, corrupt]
    found = reduce(DataFrame.unionByName, [full(p) for p in parts])
    return found.withColumn("severity", F.coalesce(_lookup(SEVERITY_OF, F.col("kind")), F.lit("healthy")))


def recovery_status(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, status: the worst severity of a run's findings, healthy without any. Findings without a run count for every run."""
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    per = findings.filter("run_id is not null").groupBy("run_id").agg(F.max(order).alias("own"))
    shared = findings.filter("run_id is null").agg(F.coalesce(F.max(order), F.lit(1)).alias("shared"))
    worst = shared.first()["shared"]  # one number
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    rank = F.greatest(F.coalesce("own", F.lit(1)), F.lit(worst)).cast("int")
    return runs.select("run_id").join(per, "run_id", "left").select("run_id", F.element_at(names, rank).alias("status"))
