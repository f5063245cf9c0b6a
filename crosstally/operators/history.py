"""Integrity checks over history tables. Every check returns its violations; no row means that it holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import OUTCOME_OF_STATE, WORK_TRANSITIONS, terminal, transition_table
from ..session import Store


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def broken_rules(df: DataFrame, ids: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """ids and rule of every rule whose condition is not true for a row."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(*ids, F.explode(failed).alias("rule"))


def check_contiguous(log: DataFrame, keys: Sequence[str], seq: str, frontier: DataFrame, frontier_col: str, first: int = 1) -> DataFrame:
    """Keys whose sequence isn't first, first + 1, ... up to the frontier (the last number; first - 1 where nothing was logged yet)."""
    g = log.groupBy(*keys).agg(F.count(seq).alias("n"), F.count_distinct(seq).alias("different"), F.min(seq).alias("low"), F.max(seq).alias("high"))
    j = g.join(frontier.select(*keys, F.col(frontier_col).alias("frontier")), list(keys), "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = (F.col("n") == 0) & (F.col("frontier") == first - 1) | (F.col("low") == first) & (F.col("high") == F.col("frontier")) & (F.col("n") == F.col("frontier") - first + 1) & (F.col("different") == F.col("n"))
    return j.filter(~F.coalesce(whole, F.lit(False))).select(*keys, "n", "low", "high", "frontier")


def with_previous(log: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str], block: int = 100_000) -> DataFrame:
    """log with ``previous``: struct(seq, columns) of the row before it in its key's sequence, null for the first.

    A key's rows are ordered in blocks of numbers, so that one very long sequence is spread over many tasks; what a block's first row
    follows is the last row of the block before, found among one row for each block.
    """
    row = F.struct(F.col(seq).alias("seq"), *columns)
    dealt = log.withColumn("block_", F.expr(f"`{seq}` div {block}"))
    tails = dealt.groupBy(*keys, "block_").agg(F.max_by(row, seq).alias("tail"))
    tails = tails.withColumn("tail_", F.lag("tail").over(Window.partitionBy(*keys).orderBy("block_"))).drop("tail")
    here = dealt.withColumn("lag_", F.lag(row).over(Window.partitionBy(*keys, "block_").orderBy(seq)))
    return here.join(tails, [*keys, "block_"], "left").withColumn("previous", F.coalesce("lag_", "tail_")).drop("block_", "lag_", "tail_")


def sequence_gaps(log: DataFrame, keys: Sequence[str], seq: str, block: int = 100_000) -> DataFrame:
    """keys, gap_from, gap_to: the missing ranges between numbers that are there, and before the first if that isn't 1."""
    before = F.coalesce("previous.seq", F.lit(0))
    told = with_previous(log.select(*keys, seq), keys, seq, [], block).withColumn("before", before)
    return told.filter(F.col(seq) > F.col("before") + 1).select(*keys, (F.col("before") + 1).alias("gap_from"), (F.col(seq) - 1).alias("gap_to"))


def replay_compare(log: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """batch with disposition: new, replay (the stored row is the same) or conflict (it is another)."""
    rest = [c for c in batch.columns if c not in keys]
    stored = log.select(*keys, F.struct(*rest).alias("stored"))
    j = batch.join(stored, list(keys), "left")
    d = F.when(F.col("stored").isNull(), "new").when(F.col("stored").eqNullSafe(F.struct(*rest)), "replay").otherwise("conflict")
    return j.select(*batch.columns, d.alias("disposition"))


def range_replay(log: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str, ranges: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """keys, seq, disposition of what differs between a replayed range and the log: missing (the batch lacks it), surplus (the log does), conflict (another row).

    ranges: keys, first, last (both included) of the ranges that the batch claims to hold whole; by default from a key's smallest number in the
    batch to its largest. Both sides are digested in blocks of numbers where they are read; only rows of blocks that differ meet, so a replay of an
    unchanged range moves a digest a block. A number that a side has twice is told as a conflict.
    """
    keys, store = list(keys), Store(log.sparkSession, "replay")
    rest = [c for c in batch.columns if c not in (*keys, seq)]
    if ranges is None:
        ranges = batch.groupBy(*keys).agg(F.min(seq).alias("first"), F.max(seq).alias("last"))
    ranges = ranges.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("first").alias("first__"), F.col("last").alias("last__"))
    inside = lambda df: reduce(lambda a, b: a & b, [df[k] == ranges[f"{k}__"] for k in keys], (df[seq] >= ranges["first__"]) & (df[seq] <= ranges["last__"]))
    whole = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(0)

    def side(df: DataFrame) -> DataFrame:
        kept = df.select(*keys, seq, *rest)
        return kept.join(ranges, inside(kept), "left_semi").withColumn("block__", F.expr(f"`{seq}` div {block}"))

    def digests(df: DataFrame) -> DataFrame:
        told = [F.bit_xor(F.xxhash64(F.lit(salt), F.col(seq), *[F.col(c) for c in rest])) for salt in (1, 2)]
        return df.groupBy(*keys, "block__").agg(F.struct(F.count("*"), *told).alias("digest__"))

    ours, theirs = side(log), side(batch)
    a, b = digests(ours), digests(theirs).withColumnRenamed("digest__", "other__")
    differing = store.put(a.join(b, [*keys, "block__"], "full_outer").filter(~F.col("digest__").eqNullSafe(F.col("other__"))).select(*keys, "block__"))
    few = F.broadcast(differing) if differing.limit(100_001).count() <= 100_000 else differing

    def rows(df: DataFrame, name: str) -> DataFrame:
        met = df.join(few, [*keys, "block__"], "left_semi")
        return met.groupBy(*keys, seq).agg(F.sort_array(F.collect_list(whole)).alias(name))

    met = rows(ours, "stored__").join(rows(theirs, "sent__"), [*keys, seq], "full_outer")
    kind = F.when(F.col("sent__").isNull(), "missing").when(F.col("stored__").isNull(), "surplus").when(~F.col("stored__").eqNullSafe(F.col("sent__")) | (F.size("sent__") > 1), "conflict")
    return met.select(*keys, seq, kind.alias("disposition")).filter("disposition is not null")


def check_event_subjects(events: DataFrame, work: DataFrame) -> DataFrame:
    """Events about another run than their own, or about a work item that isn't of their run."""
    wrong_run = events.filter("subject_kind = 'run' and not (subject_id <=> run_id)").withColumn("rule", F.lit("run_subject"))
    items = work.select("run_id", F.col("work_item_id").alias("subject_id"))
    wrong_work = events.filter("subject_kind = 'work_item'").join(items, ["run_id", "subject_id"], "left_anti").withColumn("rule", F.lit("work_subject"))
    return wrong_run.select("run_id", "sequence_number", "subject_id", "rule").unionByName(wrong_work.select("run_id", "sequence_number", "subject_id", "rule"))


def check_chronology(runs: DataFrame, events: DataFrame, checkpoints: DataFrame, manifests: DataFrame) -> DataFrame:
    """rule, id of facts that lie before what they follow from."""
    created = runs.select("run_id", F.col("created_at").alias("run_created_at"))
    fact = lambda df, rule, ident: df.select(F.lit(rule).alias("rule"), ident.cast("string").alias("id"))
    early = fact(events.join(created, "run_id").filter("occurred_at < run_created_at"), "event_before_run", F.concat_ws("/", "run_id", "sequence_number"))
    ended = fact(runs.filter("finished_at < started_at or started_at < created_at"), "run_times", F.col("run_id"))
    made = manifests.select("artifact_id", F.col("created_at").alias("artifact_created_at"))
    late = fact(checkpoints.join(made, "artifact_id").filter("artifact_created_at > created_at"), "artifact_after_checkpoint", F.concat_ws("/", "run_id", "node_id", "partition_key", "version"))
    old = fact(manifests.join(created, "run_id").filter("created_at < run_created_at"), "manifest_before_run", F.col("artifact_id"))
    return early.unionByName(ended).unionByName(late).unionByName(old)


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint of the highest version of each (run, node, partition)."""
    keys = ["run_id", "node_id", "partition_key"]
    rest = [c for c in checkpoints.columns if c not in keys]
    return checkpoints.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(*keys, "x.*")


def check_checkpoint_frontier(work: DataFrame, heads: DataFrame) -> DataFrame:
    """work_item_id, rule: no head, another version than expected, success without a checkpoint."""
    j = work.join(heads.select("run_id", "node_id", "partition_key", "version"), ["run_id", "node_id", "partition_key"], "left")
    rules = {"missing_head": F.col("version").isNotNull(), "version": F.col("version").isNull() | F.col("version").eqNullSafe(F.col("expected_checkpoint_version")), "success_without_checkpoint": (F.col("state") != "succeeded") | F.col("version").isNull() | (F.col("version") >= 1)}
    return broken_rules(j, ["work_item_id"], rules)


def check_checkpoint_artifacts(checkpoints: DataFrame, manifests: DataFrame) -> DataFrame:
    """Checkpoints whose artifact is unknown or is another partition's."""
    m = manifests.select("artifact_id", F.struct("run_id", "node_id", "partition_key").alias("owner"))
    j = checkpoints.filter("artifact_id is not null").join(m, "artifact_id", "left")
    rule = F.when(F.col("owner").isNull(), "unknown_artifact").when(~F.col("owner").eqNullSafe(F.struct("run_id", "node_id", "partition_key")), "other_partition")
    return j.select("run_id", "node_id", "partition_key", "version", "artifact_id", rule.alias("rule")).filter("rule is not null")


def illegal_transitions(history: DataFrame, keys: Sequence[str], seq: str, lifecycle: Mapping[str, tuple[str, ...]], block: int = 100_000) -> DataFrame:
    """keys, seq, from_state, to_state of moves that the lifecycle doesn't have."""
    told = with_previous(history.select(*keys, seq, "state"), keys, seq, ["state"], block).filter("previous is not null")
    moves = told.select(*keys, seq, F.col("previous.state").alias("from_state"), F.col("state").alias("to_state"))
    legal = transition_table(history.sparkSession, dict(lifecycle))
    return moves.join(F.broadcast(legal), ["from_state", "to_state"], "left_anti").select(*keys, seq, "from_state", "to_state")  # bound: the fixed lifecycle


def check_snapshot_change(before: DataFrame, after: DataFrame, keys: Sequence[str], immutable: Sequence[str] = (), monotonic: Sequence[str] = (), state: str | None = None, terminal_states: Sequence[str] = ()) -> DataFrame:
    """keys, rule, column of what must not happen between two snapshots of a table."""
    cols = [c for c in before.columns if c not in keys]
    j = before.select(*keys, F.struct(*cols).alias("b")).join(after.select(*keys, F.struct(*cols).alias("a")), list(keys), "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    row = lambda rule, c: F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"))
    rules = [F.when(F.col("a").isNull(), row("deleted", ""))]
    rules += [F.when(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), row("immutable", c)) for c in immutable]
    rules += [F.when(both & (F.col(f"a.{c}") < F.col(f"b.{c}")), row("monotonic", c)) for c in monotonic]
    if state:
        rules.append(F.when(both & F.col(f"b.{state}").isin(*terminal_states) & ~F.col("a").eqNullSafe(F.col("b")), row("terminal", state)))
    return j.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("x")).select(*keys, "x.*")


def check_foreign_keys(tables: Mapping[str, DataFrame], keys: Sequence[tuple]) -> DataFrame:
    """table, columns, value of rows whose parent is missing; a null key refers to nothing. One anti join for each key."""
    found = []
    for child, cols, parent, parent_cols in keys:
        if child in tables and parent in tables:
            c = tables[child].select(*cols).dropna().distinct()
            p = tables[parent].select(*[F.col(x).alias(y) for x, y in zip(parent_cols, cols)]).distinct()
            found.append(c.join(p, list(cols), "left_anti").select(F.lit(child).alias("table"), F.lit(",".join(cols)).alias("columns"), F.concat_ws("/", *[F.col(x).cast("string") for x in cols]).alias("value")))
    return reduce(DataFrame.unionByName, found)


def check_unique(tables: Mapping[str, DataFrame], keys: Sequence[tuple]) -> DataFrame:
    """table, columns, value, n of keys that more than one row has."""
    found = []
    for name, cols in keys:
        if name in tables:
            g = tables[name].dropna(subset=list(cols)).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
            found.append(g.select(F.lit(name).alias("table"), F.lit(",".join(cols)).alias("columns"), F.concat_ws("/", *[F.col(x).cast("string") for x in cols]).alias("value"), "n"))
    return reduce(DataFrame.unionByName, found)


def unfinished_work(work: DataFrame, nodes: DataFrame) -> DataFrame:
    """run_id, kind, id, state of work items and nodes that keep a run from its end."""
    w = work.filter(~F.col("state").isin(*terminal(WORK_TRANSITIONS))).select("run_id", F.lit("work_item").alias("kind"), F.col("work_item_id").alias("id"), "state")
    n = nodes.filter(F.col("status").isin("pending", "running")).select("run_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("status").alias("state"))
    return w.unionByName(n)


def event_trace(events: DataFrame, block: int = 10_000) -> DataFrame:
    """run_id, block, kinds: the kinds of a run's events in order of their numbers, in blocks of numbers so that no row grows without bound."""
    part = F.expr(f"(sequence_number - 1) div {block}")
    g = events.groupBy("run_id", part.alias("block")).agg(F.array_sort(F.collect_list(F.struct("sequence_number", "kind"))).alias("x"))
    return g.select("run_id", "block", F.transform("x", lambda e: e["kind"]).alias("kinds"))


def check_attempts(attempts: DataFrame) -> DataFrame:
    """work_item_id, attempt_number, rule of attempt rows that contradict themselves."""
    took = F.unix_micros("finished_at") - F.unix_micros("started_at")
    rules = {
        "times": took >= 0,
        "duration": took == F.col("duration_microseconds"),
        "failure_class": (F.col("outcome") == "succeeded") == F.col("failure_class").isNull(),
        "lease_expired": (F.col("outcome") != "lease_expired") | F.col("failure_class").eqNullSafe(F.lit("timeout")),
    }
    return broken_rules(attempts, ["work_item_id", "attempt_number"], rules)


def check_attempt_traces(events: DataFrame, terminal_kinds: Sequence[str] = ("attempt_succeeded", "attempt_failed", "attempt_cancelled"), start_kind: str = "attempt_started") -> DataFrame:
    """work_item_id, attempt_number, rule: exactly one start, at most one end, the end after the start, one owner throughout."""
    ends = F.col("kind").isin(*terminal_kinds)
    starts = F.col("kind") == start_kind
    g = events.groupBy("work_item_id", "attempt_number").agg(
        F.count_if(starts).alias("starts"), F.count_if(ends).alias("ends"), F.count_if(~starts & ~ends).alias("others"), F.min(F.when(starts, F.col("occurred_at"))).alias("t0"), F.min(F.when(ends, F.col("occurred_at"))).alias("t1"), F.count_distinct("context").alias("contexts")
    )
    rules = {"start": F.col("starts") == 1, "end": F.col("ends") <= 1, "kind": F.col("others") == 0, "order": F.col("t1").isNull() | (F.col("t1") >= F.col("t0")), "context": F.col("contexts") <= 1}
    return broken_rules(g, ["work_item_id", "attempt_number"], rules)


def check_state_outcome(work: DataFrame, attempts: DataFrame) -> DataFrame:
    """work_item_id, state, last_outcome where the last attempt ended otherwise than the state says."""
    last = attempts.groupBy("work_item_id").agg(F.max_by("outcome", "attempt_number").alias("last_outcome"))
    said = F.create_map(*[F.lit(x) for kv in OUTCOME_OF_STATE.items() for x in kv])
    j = work.join(last, "work_item_id", "left").withColumn("expected", F.try_element_at(said, F.col("state")))
    fine = F.col("expected").isNull() | F.col("last_outcome").eqNullSafe(F.col("expected")) | ((F.col("state") == "retry_wait") & (F.col("last_outcome") == "lease_expired"))
    return j.filter(~F.coalesce(fine, F.lit(False))).select("work_item_id", "state", "last_outcome")


def check_node_timestamps(nodes: DataFrame) -> DataFrame:
    """run_id, node_id of nodes whose times don't fit their status."""
    s, f = F.col("started_at"), F.col("finished_at")
    fine = F.when(F.col("status") == "pending", s.isNull() & f.isNull()).when(F.col("status") == "running", s.isNotNull() & f.isNull()).otherwise(s.isNotNull() & f.isNotNull() & (f >= s))
    return broken_rules(nodes, ["run_id", "node_id"], {"timestamps": fine})
