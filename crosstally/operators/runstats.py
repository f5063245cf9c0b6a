"""Statistics of runs from their history tables. Everything is keyed by run, so all runs are computed at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Store

PERCENTS = (50, 95, 99)
WORK_BUCKETS = ("pending", "running", "succeeded", "quarantined", "failed", "cancelled")
COUNTERS = ("records_read", "records_written", "records_quarantined", "bytes_read", "bytes_written")
RETRIED = ("retry_scheduled", "lease_expired")


def bucket_of(state: Column) -> Column:
    """The aggregate's bucket of a work state; retry_wait counts as pending. Other states have none."""
    return F.when(state.isin("pending", "retry_wait"), "pending").when(state.isin(*WORK_BUCKETS[1:]), state)


#: Rows of a group up to which Spark's own exact percentile is used: it keeps every different value of a group in one buffer.
LARGE = 100_000
#: Bits that one counting pass tells apart.
DIGIT = 12


def _equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys of a with those of b, which there bear an underscore; nulls are equal."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{k}_"]) for k in keys])


def _named(df: DataFrame, keys: Sequence[str], *rest) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{k}_") for k in keys], *rest)


def _known(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, a stored table, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def selected(df: DataFrame, keys: Sequence[str], column: str, percents: Sequence[int] = PERCENTS) -> DataFrame:
    """keys, percent, value: nearest-rank percentiles by counting digits, for groups of any size; nulls don't count.

    Values are numbers of 64 bits, of which all rows share some first ones. Each pass counts the next DIGIT bits of the rows whose bits so
    far are those of a sought value, finds the digit in which its rank lies, and goes on below it. Counts are made where rows are read, so a
    group moves 2^DIGIT counts a task and percentile at most, and holds as many when they meet.
    """
    spark, n_keys = df.sparkSession, list(keys)
    store = Store(spark, "selected")
    # as unsigned numbers that keep the order
    rows = df.select(*keys, F.col(column).cast("long").bitwiseXOR(F.lit(-(1 << 63))).alias("u__")).filter("u__ is not null")
    low, high = rows.agg(F.min(F.col("u__").bitwiseXOR(F.lit(-(1 << 63)))), F.max(F.col("u__").bitwiseXOR(F.lit(-(1 << 63))))).first()
    if low is None:
        return df.select(*keys, F.lit(0).alias("percent"), F.col(column).cast("long").alias("value")).limit(0)
    unsigned = [x + (1 << 63) for x in (low, high)]
    left = (unsigned[0] ^ unsigned[1]).bit_length()
    above = lambda bits: F.shiftrightunsigned("u__", bits) if bits < 64 else F.lit(0).cast("long")
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.expr(f"(of__ * {p} + 99) div 100").alias("rank__")) for p in percents])).alias("r__")
    sought = rows.groupBy(*keys).agg(F.count("*").alias("of__")).select(*keys, ranks).select(*keys, "r__.*")
    prefix = unsigned[0] >> left if left < 64 else 0
    sought = store.put(sought.withColumn("prefix__", F.lit(prefix - (1 << 64) if prefix >= 1 << 63 else prefix).cast("long")))
    while left:
        bits = max(0, left - DIGIT)
        wanted = _named(sought, n_keys, F.col("prefix__").alias("prefix_in__")).distinct()
        wanted = _known(store.put(wanted))
        met = rows.withColumn("before__", above(left))
        counted = met.join(wanted, _equal(met, wanted, n_keys) & (met["before__"] == wanted["prefix_in__"])).groupBy(*keys, "before__", above(bits).alias("digit__")).agg(F.count("*").alias("k__"))
        counted = _named(counted, n_keys, F.col("before__").alias("prefix_in__"), "digit__", "k__")
        found = sought.join(counted, _equal(sought, counted, n_keys) & (sought["prefix__"] == counted["prefix_in__"])).select(*[sought[k] for k in keys], "percent", "rank__", "digit__", "k__")
        w = Window.partitionBy(*keys, "percent").orderBy(F.col("digit__").bitwiseXOR(F.lit(-(1 << 63))) if bits == 0 else F.col("digit__"))  # 2^DIGIT rows at most
        found = found.withColumn("upto__", F.sum("k__").over(w)).filter((F.col("upto__") >= F.col("rank__")) & (F.col("upto__") - F.col("k__") < F.col("rank__")))
        sought = store.put(found.select(*keys, "percent", (F.col("rank__") - F.col("upto__") + F.col("k__")).alias("rank__"), F.col("digit__").alias("prefix__")))
        left = bits
    return sought.select(*keys, "percent", F.col("prefix__").bitwiseXOR(F.lit(-(1 << 63))).alias("value"))


def percentiles(df: DataFrame, keys: Sequence[str], column: str = "duration_microseconds", large: int = LARGE) -> DataFrame:
    """keys, attempts (rows), and exact nearest-rank percentiles: Spark's own for groups of at most ``large`` rows, by counting digits for others."""
    keys, names = list(keys), [f"p{p}_microseconds" for p in PERCENTS]
    own = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").cast("long").alias(n) for p, n in zip(PERCENTS, names)]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("attempts"))
    if not sizes.filter(F.col("attempts") > large).limit(1).count():
        return df.groupBy(*keys).agg(F.count("*").alias("attempts"), *own)
    sizes = Store(df.sparkSession, "percentiles").put(sizes)
    hot = _named(sizes.filter(F.col("attempts") > large), keys)
    few = _known(hot)  # one row for each ``large`` rows at most
    small = df.join(few, _equal(df, few, keys), "left_anti").groupBy(*keys).agg(F.count("*").alias("attempts"), *own)
    long = selected(df.join(few, _equal(df, few, keys), "left_semi"), keys, column)
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(n) for p, n in zip(PERCENTS, names)])
    wide = _named(wide, keys, *names)
    mine = sizes.filter(F.col("attempts") > large)
    return small.unionByName(mine.join(wide, _equal(mine, wide, keys), "left").select(*keys, "attempts", *names))


def node_latency(attempts: DataFrame, large: int = LARGE) -> DataFrame:
    """run_id, node_id, attempts and nearest-rank percentiles of their durations."""
    return percentiles(attempts, ["run_id", "node_id"], large=large)


def latency_by_rank(attempts: DataFrame, *keys: str) -> DataFrame:
    """The same percentiles, all by counting digits: rank (n * p + 99) div 100."""
    return percentiles(attempts, keys, large=0)


def ranked_attempts(attempts: DataFrame, *keys: str) -> DataFrame:
    """attempts with their rank by (duration, work item, attempt) among those of the same keys, and how many these are.

    One range sort over all keys together; a range's rows of a key are numbered where they stand, and follow those of the ranges before.
    A key of any size, and any number of equal durations, is spread over as many ranges as it fills; windows see a row a key and range.
    """
    keys, order = list(keys), ["duration_microseconds", "work_item_id", "attempt_number"]
    ranged = attempts.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("at_", F.monotonically_increasing_id())
    ranged = Store(attempts.sparkSession, "ranked").put(ranged).withColumn("range_", F.shiftright("at_", 33))
    heads = ranged.groupBy(*keys, "range_").agg(F.min("at_").alias("first_"), F.count("*").alias("k_"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("k_").over(w.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = _named(heads.withColumn("of", F.sum("k_").over(w)).withColumn("before_", before), keys, F.col("range_").alias("in_"), "first_", "before_", "of")
    placed = ranged.join(heads, _equal(ranged, heads, keys) & (ranged["range_"] == heads["in_"]))
    return placed.withColumn("rank", F.col("before_") + F.col("at_") - F.col("first_") + 1).select(*attempts.columns, "rank", "of")


def node_statistics(nodes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Node columns with attempts (0 without any) and percentiles."""
    return nodes.join(node_latency(attempts), ["run_id", "node_id"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def run_summary(runs: DataFrame, nodes: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row for each run: sums over its nodes, percentiles over its attempts."""
    summed = ["work_total", *(f"work_{b}" for b in WORK_BUCKETS), *COUNTERS, "retry_count", "duration_microseconds"]
    by_node = nodes.groupBy("run_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed])
    by_attempt = percentiles(attempts, ["run_id"])
    out = runs.select("run_id", "state").join(by_node, "run_id", "left").join(by_attempt, "run_id", "left")
    return out.fillna(0, [*summed, "attempts"])


def derive_node_aggregates(work: DataFrame, attempts: DataFrame) -> DataFrame:
    """run_id, node_id and the aggregates that the work items and attempts imply: buckets, attempts, retries, duration, earliest start (active attempts too), latest finish."""
    bucket, active = bucket_of(F.col("state")), F.lit(None).cast("timestamp")
    if "active_attempt_started_at" in work.columns:
        active = F.col("active_attempt_started_at")
    w = work.groupBy("run_id", "node_id").agg(F.count("*").alias("work_total"), F.min(active).alias("active_at"), *[F.count_if(bucket == b).alias(f"work_{b}") for b in WORK_BUCKETS], F.count_if(bucket.isNull()).alias("work_unknown"))
    a = attempts.groupBy("run_id", "node_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("outcome").isin(*RETRIED)).alias("retry_count"), F.sum("duration_microseconds").alias("duration_microseconds"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at")
    )
    out = w.join(a, ["run_id", "node_id"], "full_outer").withColumn("started_at", F.least("started_at", "active_at")).drop("active_at")
    return out.fillna(0, ["work_total", *(f"work_{b}" for b in WORK_BUCKETS), "work_unknown", "attempts", "retry_count", "duration_microseconds"])


def node_status(aggregates: DataFrame) -> DataFrame:
    """aggregates with derived_status; a node has started if it has an attempt, an active one included."""
    c = F.col
    status = (
        F.when(c("work_total") == 0, "pending")
        .when((c("work_pending") + c("work_running") > 0) & (c("attempts") + c("work_running") > 0), "running")
        .when(c("work_pending") + c("work_running") > 0, "pending")
        .when(c("work_failed") > 0, "failed")
        .when(c("work_cancelled") == c("work_total"), "cancelled")
        .when(c("work_quarantined") + c("work_cancelled") > 0, "partially_succeeded")
        .otherwise("succeeded")
    )
    return aggregates.withColumn("derived_status", status)


def run_outcome(work: DataFrame) -> DataFrame:
    """run_id, outcome: failed if any work item failed, succeeded if all succeeded, else partially_succeeded."""
    g = work.groupBy("run_id").agg(F.bool_or(F.col("state") == "failed").alias("f"), F.bool_and(F.col("state") == "succeeded").alias("s"))
    return g.select("run_id", F.when(F.col("f"), "failed").when(F.col("s"), "succeeded").otherwise("partially_succeeded").alias("outcome"))


DRIFTING = ("work_total", *(f"work_{b}" for b in WORK_BUCKETS), "retry_count", "duration_microseconds")


def aggregate_drift(nodes: DataFrame, work: DataFrame, attempts: DataFrame) -> DataFrame:
    """run_id, node_id, column, stored, derived: a row for each stored aggregate that isn't what the history implies."""
    stored = nodes.select("run_id", "node_id", F.struct(*DRIFTING).alias("s"))
    derived = derive_node_aggregates(work, attempts).select("run_id", "node_id", F.struct(*DRIFTING).alias("d"))
    j = stored.join(derived, ["run_id", "node_id"], "full_outer")
    zero = lambda side, c: F.when(F.col("s").isNotNull(), F.coalesce(F.col(f"{side}.{c}"), F.lit(0))).otherwise(F.col(f"{side}.{c}"))
    rows = [F.when(~zero("s", c).eqNullSafe(zero("d", c)), F.struct(F.lit(c).alias("column"), zero("s", c).alias("stored"), zero("d", c).alias("derived"))) for c in DRIFTING]
    return j.select("run_id", "node_id", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("run_id", "node_id", "x.*")


def check_metrics(stats: DataFrame) -> DataFrame:
    """run_id, node_id, rule: buckets must add up to the total, retries can't exceed attempts, nothing is negative."""
    total = reduce(lambda a, b: a + b, [F.col(f"work_{b}") for b in WORK_BUCKETS])
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in DRIFTING])
    rules = [F.when(total != F.col("work_total"), "buckets"), F.when(F.col("retry_count") > F.col("attempts"), "retries"), F.when(negative, "negative")]
    return stats.select("run_id", "node_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def accumulate_metrics(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """run_id, node_id and the counters after all deltas; an overflow is an error under ANSI arithmetic."""
    cols = [*COUNTERS, "duration_microseconds"]
    both = nodes.select("run_id", "node_id", *cols).unionByName(deltas.select("run_id", "node_id", *cols))
    return both.groupBy("run_id", "node_id").agg(*[F.sum(c).alias(c) for c in cols])


def check_summary(runs: DataFrame, nodes: DataFrame, work: DataFrame, attempts: DataFrame) -> DataFrame:
    """run_id, column, stored, derived where the summary over nodes and the work items and attempts themselves disagree."""
    a = run_summary(runs, nodes, attempts)
    bucket = bucket_of(F.col("state"))
    w = work.groupBy("run_id").agg(F.count("*").alias("work_total"), *[F.count_if(bucket == b).alias(f"work_{b}") for b in WORK_BUCKETS])
    t = attempts.groupBy("run_id").agg(F.count_if(F.col("outcome").isin(*RETRIED)).alias("retry_count"), F.sum("duration_microseconds").alias("duration_microseconds"))
    b = runs.select("run_id").join(w, "run_id", "left").join(t, "run_id", "left").fillna(0)
    long = lambda df, name: df.select("run_id", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in DRIFTING]), F.array(*[F.col(c).cast("long") for c in DRIFTING]))).alias("column", name))
    return long(a, "stored").join(long(b, "derived"), ["run_id", "column"]).filter(~F.col("stored").eqNullSafe(F.col("derived")))


def check_source_counts(expected: dict[str, int], **tables: DataFrame) -> DataFrame:
    """table, expected, found of loaded tables that don't have the expected number of rows."""
    counts = [df.agg(F.count("*").alias("found")).select(F.lit(k).alias("table"), F.lit(expected[k]).cast("long").alias("expected"), "found") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).filter("expected <> found")


#: Counts of a node that two runs of one plan should share; durations and bytes are metrics, and may differ.
COMPARED = ("work_total", *(f"work_{b}" for b in WORK_BUCKETS), "records_read", "records_written", "records_quarantined")


def compare_runs(runs: DataFrame, nodes: DataFrame, work: DataFrame, heads: DataFrame, manifests: DataFrame, a: str, b: str) -> DataFrame:
    """node_id, partition_key, what, in_a, in_b: where two runs differ in their plan, a node's counts, a work item's state, a checkpoint's version or the artifacts of a partition.

    Artifacts are compared by their number and the sum of the first 32 bits of their digests, whatever their order and names.
    """
    none = F.lit(None).cast("string")
    place = ["run_id", "node_id", "partition_key"]
    fact = lambda df, what, value: df.select(*place, F.lit(what).alias("what"), value.cast("string").alias("value"))
    counts = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in COMPARED]))
    made = manifests.groupBy(*place).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long")).cast("string")).alias("told"))
    facts = [
        runs.select("run_id", none.alias("node_id"), none.alias("partition_key"), F.lit("plan").alias("what"), F.col("plan_fingerprint").alias("value")),
        nodes.select("run_id", "node_id", none.alias("partition_key"), counts.alias("x")).select(*place, "x.*"),
        fact(work, "state", F.col("state")),
        fact(heads, "checkpoint", F.col("version")),
        fact(made, "artifacts", F.col("told")),
    ]
    both = reduce(DataFrame.unionByName, facts).filter(F.col("run_id").isin(a, b))
    g = both.groupBy("node_id", "partition_key", "what").agg(F.max(F.when(F.col("run_id") == a, F.col("value"))).alias("in_a"), F.max(F.when(F.col("run_id") == b, F.col("value"))).alias("in_b"))
    return g.filter(~F.col("in_a").eqNullSafe(F.col("in_b")))


def run_state_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("state").agg(F.count("*").alias("n"))
