"""Reconciliation of two inventory sides, key by key.

Each side is aggregated by SKU (partial sums before the shuffle, so a key with very many rows costs no more than any other), the two
aggregates meet in one full outer join on that key, whose partitioning both aggregations already have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_utc, money_to_text
from ..schemas import CLASSES, FIELDS, PRICE, REPAIRABLE, require_empty
from .paging import ordered_blocks

MAX_RECORDS_PER_KEY = 1024
MAX_FILES_PER_SIDE = 1024


def business_fields(df: DataFrame) -> list[Column]:
    """The five compared fields; attributes in key order, so their order in the source doesn't count."""
    return [F.col("name"), F.col("quantity"), F.struct(*PRICE).alias("unit_price"), F.col("updated_at"), F.array_sort("attributes").alias("attributes")]


def aggregate_side(df: DataFrame) -> DataFrame:
    """sku, n, first: how many rows a key has, and the business fields of its first row by (record_index, connector_id, source_record_key)."""
    keyed = df.select("sku", F.struct(*business_fields(df)).alias("fields"), F.struct("record_index", "connector_id", "source_record_key").alias("place"))
    return keyed.groupBy("sku").agg(F.count("*").alias("n"), F.min_by("fields", "place").alias("first"))


def classify(source: Column, target: Column, differs: Column) -> Column:
    """One of seven classes from the two counts and whether a one-to-one key differs."""
    return (
        F.when((source > 1) & (target > 1), "duplicate_both")
        .when(source > 1, "duplicate_source")
        .when(target > 1, "duplicate_target")
        .when(target == 0, "missing_from_target")
        .when(source == 0, "missing_from_source")
        .when(differs, "field_mismatch")
        .otherwise("match")
    )


def joined_sides(reference: DataFrame, target: DataFrame) -> DataFrame:
    """sku, source_count, target_count, s, t: both sides' first fields."""
    s = aggregate_side(reference).select("sku", F.col("n").alias("sn"), F.col("first").alias("s"))
    t = aggregate_side(target).select("sku", F.col("n").alias("tn"), F.col("first").alias("t"))
    zero = F.lit(0).cast("long")
    return s.join(t, "sku", "full_outer").select("sku", F.coalesce("sn", zero).alias("source_count"), F.coalesce("tn", zero).alias("target_count"), "s", "t")


def reconcile(reference: DataFrame, target: DataFrame) -> DataFrame:
    """The nine-column outcome table: a row for each key of either side."""
    j = joined_sides(reference, target)
    one = (F.col("source_count") == 1) & (F.col("target_count") == 1)
    differs = {f: one & ~F.col(f"s.{f}").eqNullSafe(F.col(f"t.{f}")) for f in FIELDS}
    any_differs = reduce(lambda a, b: a | b, differs.values())
    kind = classify(F.col("source_count"), F.col("target_count"), any_differs)
    return j.select("sku", "source_count", "target_count", kind.alias("classification"), *[d.alias(f"{f}_mismatch") for f, d in differs.items()])


def _shown(side: str) -> list[Column]:
    """The five fields as texts, in order."""
    f = lambda n: F.col(f"{side}.{n}")
    price = F.concat_ws("|", f("unit_price.unit_price_minor_units").cast("string"), f("unit_price.unit_price_currency"), f("unit_price.unit_price_exponent").cast("string"))
    return [f("name"), f("quantity").cast("string"), price, format_utc(f("updated_at")), F.to_json(f("attributes"))]


def field_differences(reference: DataFrame, target: DataFrame) -> DataFrame:
    """sku, position, field, source_value, target_value: a row for each differing field of one-to-one keys, in the fixed order."""
    j = joined_sides(reference, target).filter("source_count = 1 and target_count = 1")
    rows = [
        F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"t.{f}")), F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), a.alias("source_value"), b.alias("target_value")))
        for i, (f, a, b) in enumerate(zip(FIELDS, _shown("s"), _shown("t")))
    ]
    return j.select("sku", F.explode(F.array_compact(F.array(*rows))).alias("d")).select("sku", "d.*")


def _records(df: DataFrame) -> DataFrame:
    return df.select("sku", F.struct("record_index", "connector_id", "source_record_key", *business_fields(df)).alias("record"))


def outcome_records(reference: DataFrame, target: DataFrame, limit: int = MAX_RECORDS_PER_KEY) -> DataFrame:
    """sku, source_records, target_records: the full records of every key, sorted. A key with more records on a side than the bound is an error; record_blocks takes any number."""
    both = _records(reference).withColumn("side", F.lit("s")).unionByName(_records(target).withColumn("side", F.lit("t")))
    n = both.groupBy("sku").agg(F.count_if(F.col("side") == "s").alias("sn"), F.count_if(F.col("side") == "t").alias("tn"))
    require_empty(n.filter((F.col("sn") > limit) | (F.col("tn") > limit)), f"keys with more than {limit} records on a side")
    collected = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("record"))))
    return both.groupBy("sku").agg(collected("s").alias("source_records"), collected("t").alias("target_records"))


def record_blocks(reference: DataFrame, target: DataFrame, limit: int = MAX_RECORDS_PER_KEY) -> DataFrame:
    """sku, block, source_records, target_records: the full records of every key, sorted, in blocks of at most limit records (source first)."""
    both = _records(reference).withColumn("side", F.lit("s")).unionByName(_records(target).withColumn("side", F.lit("t")))
    collected = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("record"))))
    return ordered_blocks(both, ["sku"], ["side", "record"], limit).groupBy("sku", "block").agg(collected("s").alias("source_records"), collected("t").alias("target_records"))


def check_duplicate_bounds(outcomes: DataFrame, limit: int = MAX_RECORDS_PER_KEY) -> DataFrame:
    """Keys with more records on a side than the bound."""
    return outcomes.filter((F.col("source_count") > limit) | (F.col("target_count") > limit)).select("sku", "source_count", "target_count")


def records_for(df: DataFrame, page: DataFrame) -> DataFrame:
    """The records of a page's keys, in order. A page has at most 100 keys and the one that tells of a next page; a longer one is an error."""
    keys = page.select("sku").limit(102).collect()
    if len(keys) > 101:
        raise ValueError("a page has at most 101 keys")
    listed = df.sparkSession.createDataFrame([(r["sku"],) for r in keys], "sku string")
    return df.join(F.broadcast(listed), "sku", "left_semi").orderBy("sku", "record_index", "connector_id", "source_record_key")


def reconcile_by_union(reference: DataFrame, target: DataFrame) -> DataFrame:
    """The same outcome table by another way, one conditional aggregation over both sides; used to check reconcile()."""
    rows = lambda df, side: df.select("sku", F.lit(side).alias("side"), *business_fields(df))
    both = rows(reference, 0).unionByName(rows(target, 1))
    n = lambda side: F.count_if(F.col("side") == side)
    value = lambda f, side: F.max(F.when(F.col("side") == side, F.struct(F.lit(1), F.col(f))))
    g = both.groupBy("sku").agg(n(0).alias("source_count"), n(1).alias("target_count"), *[(~value(f, 0).eqNullSafe(value(f, 1))).alias(f"d_{f}") for f in FIELDS])
    one = (F.col("source_count") == 1) & (F.col("target_count") == 1)
    kind = classify(F.col("source_count"), F.col("target_count"), reduce(lambda a, b: a | b, [F.col(f"d_{f}") for f in FIELDS]))
    return g.select("sku", "source_count", "target_count", kind.alias("classification"), *[(one & F.col(f"d_{f}")).alias(f"{f}_mismatch") for f in FIELDS])


def cross_check(outcomes: DataFrame, reference: DataFrame, target: DataFrame) -> DataFrame:
    """Rows on which the two ways disagree, with the side that has them (empty: they agree)."""
    other = reconcile_by_union(reference, target)
    return outcomes.exceptAll(other).withColumn("only_in", F.lit("outcomes")).unionByName(other.exceptAll(outcomes).withColumn("only_in", F.lit("check")))


def repairable(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("classification").isin(*REPAIRABLE))


def reconciliation_summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    """A count for each class and the total, for each value of the keys (a run, say)."""
    counts = [F.count_if(F.col("classification") == c).alias(c) for c in CLASSES]
    return outcomes.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def check_summary_totals(summaries: DataFrame) -> DataFrame:
    """Summaries whose total is not the sum of their classes."""
    return summaries.filter(reduce(lambda a, b: a + b, [F.col(c) for c in CLASSES]) != F.col("total"))


def conflicts(outcomes: DataFrame, reference: DataFrame, target: DataFrame) -> DataFrame:
    """A row for each key that doesn't match: references to its records, its differences and the suggested action."""
    bad = outcomes.filter("classification <> 'match'").select("sku", "classification")
    d = field_differences(reference, target).groupBy("sku").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "field", "source_value", "target_value"))), lambda x: x.dropFields("position"))).alias("differences"))
    # one reference a side is kept: the smallest; counts tell how many there are
    ref = lambda df, name: df.groupBy("sku").agg(F.min(F.struct("connector_id", "source_record_key")).alias(name))
    out = bad.join(d, "sku", "left").join(ref(reference, "source_ref"), "sku", "left").join(ref(target, "target_ref"), "sku", "left")
    action = F.when(F.col("classification") == "missing_from_target", "create_target").when(F.col("classification") == "field_mismatch", "update_target").otherwise("none")
    return out.select(F.sha2(F.concat_ws("|", "sku", "classification"), 256).alias("conflict_id"), F.col("sku").alias("canonical_key"), "classification", F.to_json("source_ref").alias("source_ref"), F.to_json("target_ref").alias("target_ref"), F.coalesce("differences", F.lit("[]")).alias("differences"), action.alias("suggested_action"))


def check_row_counts(df: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files whose rows are not as many as their manifest says (relative_path, row_count); df is read from files."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^.*/(?=[^/]+$)", "")
    n = df.select(path.alias("file")).groupBy("file").agg(F.count("*").alias("found"))
    said = manifests.select(F.regexp_replace("relative_path", r"^.*/(?=[^/]+$)", "").alias("file"), "relative_path", "row_count")
    return said.join(n, "file", "full_outer").filter(~F.col("row_count").eqNullSafe(F.col("found"))).select("file", "relative_path", "row_count", F.coalesce("found", F.lit(0)).alias("found"))


def check_manifest_set(manifests: DataFrame, media_type: str = "application/vnd.apache.parquet", schema_version: int = 1) -> DataFrame:
    """rule, detail of each rule that a side's set of manifests breaks. One pass of aggregates and two of keys."""
    twice = lambda c: manifests.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"repeated_{c}").alias("rule"), F.col(c).cast("string").alias("detail"))
    totals = manifests.agg(
        F.count("*").alias("files"),
        (F.min(F.struct("run_id", "node_id")) != F.max(F.struct("run_id", "node_id"))).alias("mixed"),
        F.count_if(~F.col("media_type").eqNullSafe(F.lit(media_type))).alias("media"),
        F.count_if(~F.col("schema_version").eqNullSafe(F.lit(schema_version))).alias("versions"),
    )
    rules = [F.when(F.col("files") > MAX_FILES_PER_SIDE, "too_many_files"), F.when(F.col("mixed"), "mixed_owner"), F.when(F.col("media") > 0, "media_type"), F.when(F.col("versions") > 0, "schema_version")]
    whole = totals.select(F.explode(F.array_compact(F.array(*rules))).alias("rule")).select("rule", F.lit(None).cast("string").alias("detail"))
    return twice("artifact_id").unionByName(twice("relative_path")).unionByName(whole)


def price_text(df: DataFrame) -> DataFrame:
    """df with unit_price as canonical money text."""
    return df.withColumn("unit_price_text", money_to_text(*[F.col(c) for c in PRICE]))
