"""Repair: derive safe actions, gate them, apply them once, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FIELDS, NORMALIZED_SCHEMA
from ..session import Store
from ..sources.buckets import BucketStore
from .fingerprint import StateTree, canonical_effect, effect_digest, inventory_fingerprint, plan_content_fingerprint, state_leaf
from .paging import ordered_blocks
from .reconcile import reconcile, repairable

MAX_ACTIONS = 10_000


def _met(df: DataFrame) -> DataFrame:
    """df, one side of a join, to be met by shuffles: an inventory's or ledger's rows take many times the bytes that its files do, by which Spark would choose to send it whole to the driver."""
    return df.hint("merge")


def generate_repairs(outcomes: DataFrame, reference: DataFrame, target: DataFrame, fingerprint: str, plan_id: str = "rpl_main") -> DataFrame:
    """One action for each repairable key: create what the target lacks, update what differs; nothing else, and never a delete.

    ``record`` is the proposed content, before_sha256 the digest of the target's row that an update expects, after_sha256 of the proposal.
    """
    keys = repairable(outcomes).select("sku", "classification")
    record = F.struct(*NORMALIZED_SCHEMA.names)
    create = F.col("classification") == "missing_from_target"
    j = keys.join(_met(reference.select("sku", record.alias("record"))), "sku").join(_met(target.select("sku", record.alias("present"))), "sku", "left")
    there = F.col("present").isNotNull()
    j = j.withColumns({"proposed_effect": canonical_effect("record."), "after_sha256": effect_digest("record."), "expected_effect": F.when(there, canonical_effect("present.")), "before_sha256": F.when(there, effect_digest("present."))})
    kind = F.when(create, "create_target").otherwise("update_target")
    ident = F.sha2(F.concat_ws("|", F.lit(plan_id), "sku", kind, "after_sha256"), 256)
    return j.select(
        F.concat(F.lit("rac_"), F.substring(ident, 1, 32)).alias("repair_action_id"), F.lit(plan_id).alias("repair_plan_id"), F.sha2(F.concat_ws("|", "sku", "classification"), 256).alias("conflict_id"), F.col("sku").alias("canonical_key"), kind.alias("kind"), F.lit("proposed").alias("status"),
        F.when(~create, F.col("before_sha256")).alias("before_sha256"), "after_sha256", F.sha2(F.concat_ws("|", F.lit(fingerprint), "sku", "after_sha256"), 256).alias("external_idempotency_key"), F.lit(fingerprint).alias("state_fingerprint"), "proposed_effect", F.when(~create, F.col("expected_effect")).alias("expected_effect"), "record",
    )


_EFFECT = "struct<attributes:array<struct<key:string,value:string>>,name:string,quantity:int,sku:string,unit_price:struct<currency:string,exponent:tinyint,minor_units:bigint>,updated_at:string>"


def derived_mismatches(proposed: Column, expected: Column) -> Column:
    """Names of the fields, in order, on which two effect texts differ."""
    a, b = F.from_json(proposed, _EFFECT), F.from_json(expected, _EFFECT)
    return F.array_compact(F.array(*[F.when(~a[f].eqNullSafe(b[f]), F.lit(f)) for f in FIELDS]))


def check_actions(actions: DataFrame) -> DataFrame:
    """repair_action_id, canonical_key, rule of every broken rule: a create has no before, an update has one, and differs from it."""
    create, update = F.col("kind") == "create_target", F.col("kind") == "update_target"
    rules = [
        F.when(~F.coalesce(create | update, F.lit(False)), "kind"),
        F.when(create & F.col("before_sha256").isNotNull(), "create_with_before"),
        F.when(update & F.col("before_sha256").isNull(), "update_without_before"),
        F.when(update & (F.col("before_sha256") == F.col("after_sha256")), "update_without_change"),
        F.when(F.col("after_sha256").isNull(), "after_missing"),
    ]
    return actions.select("repair_action_id", "canonical_key", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def check_plan_uniqueness(actions: DataFrame, limit: int = MAX_ACTIONS) -> DataFrame:
    """repair_plan_id, rule, detail: repeated ids and keys, and plans with too many actions."""
    twice = lambda c: actions.groupBy("repair_plan_id", c).agg(F.count("*").alias("n")).filter("n > 1").select("repair_plan_id", F.lit(f"repeated_{c}").alias("rule"), F.col(c).alias("detail"))
    big = actions.groupBy("repair_plan_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("repair_plan_id", F.lit("too_many_actions").alias("rule"), F.col("n").cast("string").alias("detail"))
    out = big
    for c in ("repair_action_id", "conflict_id", "canonical_key", "external_idempotency_key"):
        out = out.unionByName(twice(c))
    return out


def check_against_conflicts(actions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Actions whose conflict is unknown, or doesn't say what they do."""
    c = conflicts.select("conflict_id", F.col("canonical_key").alias("c_key"), "classification", "suggested_action")
    j = actions.join(_met(c), "conflict_id", "left")
    rule = F.when(F.col("c_key").isNull(), "unknown_conflict").when(F.col("c_key") != F.col("canonical_key"), "other_key").when(F.col("suggested_action") != F.col("kind"), "other_action")
    return j.select("repair_action_id", "canonical_key", "conflict_id", rule.alias("rule")).filter("rule is not null")


def stale_plans(plans: DataFrame, summaries: DataFrame) -> DataFrame:
    """Plans made for another reconciliation state than their run's present one (run_id, fingerprint, run_state), or of a run that didn't end well."""
    s = summaries.select("run_id", F.col("fingerprint").alias("current_fingerprint"), "run_state")
    j = plans.join(s, "run_id", "left")
    reason = F.when(F.col("current_fingerprint").isNull(), "no_state").when(~F.col("run_state").isin("succeeded", "partially_succeeded"), "run_state").when(F.col("current_fingerprint") != F.col("state_fingerprint"), "fingerprint")
    return j.select("repair_plan_id", "run_id", "state_fingerprint", "current_fingerprint", reason.alias("reason")).filter("reason is not null")


def approved_actions(actions: DataFrame, plans: DataFrame, approvals: DataFrame) -> DataFrame:
    """Actions of plans that someone approved for the very state they were made for."""
    ok = plans.join(approvals, ["repair_plan_id", "state_fingerprint"], "left_semi").select("repair_plan_id")
    return actions.join(ok, "repair_plan_id", "left_semi")


def apply_repairs(target: DataFrame, actions: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new target, ledger rows): creates where the key is absent, updates where the row is still the expected one.

    Actions whose external key is in the ledger already have no further effect. A row of the ledger says applied, or conflict when the
    target changed meanwhile (its row is kept as it is). Keys with several target rows are never updated. Applying twice changes nothing.
    """
    verdict = _verdicts(target, actions, ledger)
    return _applied(target, verdict), _entries(verdict)


def _verdicts(target: DataFrame, actions: DataFrame, ledger: DataFrame, *told: Column) -> DataFrame:
    """A row for each action that the ledger doesn't have as applied: whether it is ok, and of its key's target rows how many there are (null: none) and the least digest and told."""
    todo = actions.join(_met(ledger.filter("status = 'applied'").select("external_idempotency_key").distinct()), "external_idempotency_key", "left_anti")
    a = todo.select(F.col("canonical_key").alias("sku"), "repair_action_id", "external_idempotency_key", "kind", F.col("before_sha256").alias("before"), "after_sha256", "record")
    rows = target.select("sku", effect_digest().alias("now"), *told)
    state = rows.groupBy("sku").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in rows.columns[1:]])
    ok = F.when(F.col("kind") == "create_target", F.col("n").isNull()).otherwise((F.col("n") == 1) & F.col("now").eqNullSafe(F.col("before")))
    return a.join(_met(state), "sku", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))


def _applied(target: DataFrame, verdict: DataFrame) -> DataFrame:
    """The target with the records of the actions that are ok."""
    done = verdict.filter("ok").select("sku", F.col("record").alias("new_row"))
    joined = target.select("sku", F.struct(*NORMALIZED_SCHEMA.names).alias("row")).join(done, "sku", "full_outer")
    return joined.select(F.coalesce("new_row", "row").alias("r")).select("r.*")


def _entries(verdict: DataFrame) -> DataFrame:
    return verdict.select("external_idempotency_key", "repair_action_id", F.when(F.col("ok"), "applied").otherwise("conflict").alias("status"), F.col("now").alias("found_sha256"), "after_sha256")


def apply_to_buckets(target: BucketStore, actions: DataFrame, ledger: DataFrame, tree: StateTree | None = None) -> tuple[int, DataFrame]:
    """apply_repairs on a stored target: only the buckets of the actions' keys are read and written; the new version's number and the ledger rows.

    target must be dealt by ``sku``; actions are read several times, so they should be stored. Verdicts are found once and stored. tree, the stored
    fingerprint tree of the target's content, is brought up to date from them: they tell the leaf of each row that was replaced, so no row is
    read or moved for it.
    """
    touched = target.buckets_of(actions.select(F.col("canonical_key").alias("sku")))
    before = target.read(touched)
    leaf = [state_leaf(canonical_effect(), tree.scope).alias("leaf")] if tree else []
    verdict = Store(target.spark, "verdicts").put(_verdicts(before, actions, ledger, *leaf))
    version = target.publish(_applied(before, verdict), touched)
    if tree:
        done = verdict.filter("ok")
        gone = done.filter("n = 1").select("sku", "leaf").distinct()  # a row goes once, however many actions replace it
        new = done.select(state_leaf(canonical_effect("record."), tree.scope).alias("leaf"), F.lit(1).alias("n"))
        tree.change(gone.select("leaf", F.lit(-1).alias("n")).unionByName(new))
    return version, _entries(verdict)


def replay_conflicts(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Results for an external key that is in the ledger with another content."""
    known = ledger.select("external_idempotency_key", F.col("after_sha256").alias("stored_sha256"))
    return results.join(known, "external_idempotency_key").filter(~F.col("after_sha256").eqNullSafe(F.col("stored_sha256")))


def plan_status(plans: DataFrame, actions: DataFrame) -> DataFrame:
    """repair_plan_id, n_actions, derived_status: failed if any action failed, applied if all are, else applying; proposed without any."""
    g = actions.groupBy("repair_plan_id").agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "applied").alias("all_applied"), F.bool_or(F.col("status") == "failed").alias("any_failed"), F.bool_and(F.col("status") == "proposed").alias("untouched"))
    status = F.when(F.col("n").isNull() | F.col("untouched"), "proposed").when(F.col("any_failed"), "failed").when(F.col("all_applied"), "applied").otherwise("applying")
    return plans.select("repair_plan_id").join(g, "repair_plan_id", "left").select("repair_plan_id", F.coalesce("n", F.lit(0)).alias("n_actions"), status.alias("derived_status"))


def plan_details(plans: DataFrame, approvals: DataFrame, actions: DataFrame, conflicts: DataFrame, limit: int = MAX_ACTIONS) -> DataFrame:
    """Plans with their approval, n_actions, block and the block's actions in order, each with its conflict's class.

    A plan has a row for each block of at most limit actions, so no row grows without bound; one without actions has a row with neither.
    """
    n = actions.groupBy("repair_plan_id").agg(F.count("*").alias("n_actions"))
    told = actions.join(conflicts.select("conflict_id", "classification"), "conflict_id", "left")
    lists = ordered_blocks(told, ["repair_plan_id"], ["canonical_key", "repair_action_id"], limit).groupBy("repair_plan_id", "block").agg(F.array_sort(F.collect_list(F.struct("canonical_key", "repair_action_id", "kind", "status", "classification"))).alias("actions"))
    out = plans.join(approvals.select("repair_plan_id", "approver", "approved_at"), "repair_plan_id", "left").join(n, "repair_plan_id", "left").join(lists, "repair_plan_id", "left")
    return out.withColumn("n_actions", F.coalesce("n_actions", F.lit(0)))


def duplicate_plan_content(plans: DataFrame) -> DataFrame:
    return plans.groupBy("run_id", "content_fingerprint").agg(F.count("*").alias("n")).filter("n > 1")


def verify_target(reference: DataFrame, target: DataFrame, expected_fingerprint: DataFrame | None = None) -> DataFrame:
    """check, detail of whatever keeps the two sides apart: keys that are still repairable, and a target that is not the expected one."""
    left = repairable(reconcile(reference, target)).select(F.lit("repairable").alias("check"), F.col("sku").alias("detail"))
    if expected_fingerprint is None:
        return left
    now = inventory_fingerprint(target).select(F.col("fingerprint").alias("detail"))
    other = now.join(expected_fingerprint.select(F.col("fingerprint").alias("detail")), "detail", "left_anti")
    return left.unionByName(other.select(F.lit("fingerprint").alias("check"), "detail"))


def action_counts(actions: DataFrame, *keys: str) -> DataFrame:
    return actions.groupBy(*keys, "kind", "status").agg(F.count("*").alias("n"))


def check_mismatch_evidence(actions: DataFrame) -> DataFrame:
    """Updates whose stored list of mismatches (array column ``mismatches``) isn't what their two contents differ in."""
    derived = derived_mismatches(F.col("proposed_effect"), F.col("expected_effect"))
    found = actions.filter("kind = 'update_target'").select("repair_action_id", "canonical_key", "mismatches", derived.alias("derived"))
    return found.filter(~F.col("mismatches").eqNullSafe(F.col("derived")) | (F.size("derived") == 0))


def check_plans(plans: DataFrame, approvals: DataFrame, actions: DataFrame) -> DataFrame:
    """repair_plan_id, rule: content that no longer has its fingerprint, approvals for another state, broken uniqueness."""
    now = plan_content_fingerprint(actions).select("repair_plan_id", F.col("fingerprint").alias("found"))
    content = plans.join(now, "repair_plan_id", "left").filter(~F.col("content_fingerprint").eqNullSafe(F.col("found"))).select("repair_plan_id", F.lit("content").alias("rule"))
    state = plans.select("repair_plan_id", "state_fingerprint").join(approvals.select("repair_plan_id", F.col("state_fingerprint").alias("approved")), "repair_plan_id").filter("state_fingerprint <> approved").select("repair_plan_id", F.lit("approval").alias("rule"))
    orphan = actions.join(plans, "repair_plan_id", "left_anti").select("repair_plan_id", F.lit("unknown_plan").alias("rule")).distinct()
    return content.unionByName(state).unionByName(orphan).unionByName(check_plan_uniqueness(actions).select("repair_plan_id", "rule").distinct())
