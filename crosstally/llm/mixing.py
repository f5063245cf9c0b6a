"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target over its size is the number of copies that each of its documents should have; the whole part is taken as it is,
the fraction is rounded so that the words of the source stay what they are. Each document enters as (w, m): its size and the words
of it that the fraction asks for, 0 < m < w. Two documents meet and one passes words to the other, in a direction drawn so that the
expected words of both stay as they were, until one of them has none or all of its words. That one is decided; the other, the
residual, goes on. The documents of a source are dealt by hash into leaves of about FAN; every leaf folds to one residual, FAN
residuals meet at the next level, and so on up a tree, one shuffle of small rows a level. Only the last residual of a source is
rounded alone, so a source's words differ from its target by less than one document.

Draws are hashes of the document and the level: reruns agree. Defined cases: null or empty text has size 0 and nothing is taken of
it; a null source is a source of its own, the last one; empty input gives no rows; a repeated row is a document of its own, with or without
an id; columns other than doc_id, text, source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents that meet in one fold, and the most equal rows that are counted as one.
FAN, PART = 32, 10_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: the words of all sources times share, by weight, at most ``most`` times a source's own words.

    What a source can't take is shared among the others by weight until none is above its limit. All sources below theirs then have
    the same target per weight; sorted by limit per weight the capped ones come first, so running sums find that level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = by_source.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)).withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _draw(key: Column, *salt) -> Column:
    """Uniform in [0, 1), the same for the same key and salt."""
    return F.shiftrightunsigned(F.xxhash64(key, *[F.lit(x) if not isinstance(x, Column) else x for x in salt]), 11) / F.lit(float(1 << 53))


_ROW = "struct<id:string,h:bigint,k:int>"
_DOC = f"struct<row:{_ROW},w:double,m:double>"


def _fold(docs: Column, level: int) -> Column:
    """struct(carry, decided): the documents meet one after the other; decided has (row, taken), carry is the residual or null."""
    done = f"array<struct<row:{_ROW},taken:boolean>>"
    start = F.struct(F.lit(None).cast(_DOC).alias("carry"), F.array().cast(done).alias("decided"))

    def meet(state: Column, doc: Column) -> Column:
        a, b = state["carry"], doc
        up = F.least(a["w"] - a["m"], b["m"])  # words that a can get from b
        down = F.least(a["m"], b["w"] - b["m"])
        rise = _draw(a["row"], b["row"], level) * (up + down) < down
        # exactly 0 or w for the one that is decided, without rounding errors
        a_full, b_full = a["w"] - a["m"] <= b["m"], b["w"] - b["m"] <= a["m"]
        first = F.when(rise, a_full).otherwise(~b_full)  # whether a is the one decided
        total = a["m"] + b["m"]
        a_taken, b_taken = rise, ~rise
        one = F.struct(F.when(first, a["row"]).otherwise(b["row"]).alias("row"), F.when(first, a_taken).otherwise(b_taken).alias("taken"))
        kept = F.when(first, b).otherwise(a)
        gone = F.when(first, F.when(a_taken, a["w"]).otherwise(0.0)).otherwise(F.when(b_taken, b["w"]).otherwise(0.0))
        m = F.least(F.greatest(total - gone, F.lit(0.0)), kept["w"])
        whole = (m <= 0) | (m >= kept["w"])  # both ended at once
        rest = F.when(~whole, F.struct(kept["row"].alias("row"), kept["w"].alias("w"), m.alias("m")))
        also = F.when(whole, F.array(F.struct(kept["row"].alias("row"), (m > 0).alias("taken")))).otherwise(F.array().cast(done))
        met = F.struct(rest.alias("carry"), F.concat(state["decided"], F.array(one), also).alias("decided"))
        return F.when(a.isNull(), F.struct(b.alias("carry"), state["decided"].alias("decided"))).otherwise(met)

    return F.aggregate(docs, start, meet)


def pivotal_round(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """row, taken for parts(source, row, w, m) with 0 < m < w; row is unique."""
    largest = parts.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(1, ceil(log(max(largest, 2), fan)))
    leaf = F.pmod(F.xxhash64("row", F.lit("leaf")), F.lit(fan ** (levels - 1)))
    now, decided = parts.select("source", leaf.alias("node"), F.struct(F.col("row"), F.col("w"), F.col("m")).cast(_DOC).alias("doc")), None
    for level in range(levels):
        folded = cut(now.groupBy("source", "node").agg(_fold(F.array_sort(F.collect_list("doc")), level).alias("f")))
        some = folded.select(F.explode("f.decided").alias("d")).select("d.row", "d.taken")
        decided = some if decided is None else decided.unionByName(some)
        now = folded.filter("f.carry is not null").select("source", F.expr(f"node div {fan}").alias("node"), F.col("f.carry").alias("doc"))
    last = now.select(F.col("doc.row").alias("row"), (_draw(F.col("doc.row"), "last") * F.col("doc.w") < F.col("doc.m")).alias("taken"))
    return decided.unionByName(last)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs(doc_id, text, source).

    A document is taken floor or ceiling of target / source_size times, never more than ``most`` (a whole number) times. Rows that are
    equal in all three columns are exchangeable: they are counted before they move and meet as one, in parts of at most PART rows. Of n
    rows with the fraction f, floor(n f) are taken once more, and only what is left of n f is rounded with the other documents.
    """
    if most != int(most) or most < 1:
        raise ValueError("most must be a whole number of at least 1")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(ASCII_WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    counted = sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("rows"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {PART}")))
    counted = counted.select("doc_id", "source", "size", "h", "rows", part.alias("part"))
    n = F.least(F.lit(PART).cast("long"), F.col("rows") - F.col("part") * PART)
    name = F.concat_ws(" ", F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("null")), F.concat(F.lit("in "), F.col("source")), F.col("size").cast("string"))
    counted = cut(counted.select("doc_id", "source", "size", n.alias("n"), F.struct(name.alias("id"), F.col("h"), F.col("part").cast("int").alias("k")).alias("row")))
    targets = cut(source_targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most).withColumnRenamed("source", "of"))
    known = counted.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.round(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), 12)
    whole = F.floor(rate)
    again = F.greatest(rate - whole, F.lit(0.0)) * F.col("n")  # how many of the n rows are taken once more
    sure = F.floor(F.round(again, 9))
    rest = F.greatest(F.round(again, 9) - sure, F.lit(0.0))
    known = known.withColumn("whole", whole).withColumn("sure", sure).withColumn("m", (rest * F.col("size")).cast("double")).withColumn("w", F.col("size").cast("double"))
    rounded = pivotal_round(known.filter("m > 0 and m < w"), fan).select("row", F.col("taken").cast("long").alias("one_more"))
    out = known.join(rounded, "row", "left").withColumn("more", F.col("sure") + F.coalesce("one_more", F.lit(0)))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = (F.col("whole") + (F.col("i") <= F.col("more")).cast("long")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
