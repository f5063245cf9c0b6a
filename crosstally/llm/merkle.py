"""A Merkle manifest of a dataset: a tree a language, one tree over their roots, and a recursive query that climbs from every leaf.

Leaves are hashed where they are read; only ids and digests move. Within a language leaves get their places from a range sort: a row's
place is that in its range, plus the rows of the ranges before. A tree is then built STRIDE levels at a time: 2^STRIDE consecutive nodes
make a run, whose levels are folded in one row, and the runs' roots are the nodes of the next round. Runs are stored; from them come
node rows, each with a link to its ancestor at the end of its run and the siblings on the way there. The recursive query takes every
leaf (tampered where asked) up these links, folds its digest with the siblings and appends them to its proof.

Levels with few nodes (counted) are joined by broadcast; the levels below by shuffle, where a key has at most the leaves below one node
of these levels. So no language, however large, is one task's work, and the number of steps is the height over STRIDE.

Defined cases: fields that are null are a dash, empty texts count zero bytes; null languages make a tree of their own, the first; null ids
come first in their language and are never tampered; rows that repeat an id are leaves of their own, ordered by digest; a single leaf is its
language's root, a single language's root is the root, and both have empty proofs of that level; an empty table has no rows; other columns
are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, small_side

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a stored link goes up.
STRIDE = 4
#: Node rows that may be sent to all tasks (some 400 bytes each).
BROADCAST_ROWS = 65_536
#: The tree over the languages' roots; languages' own names begin with a sign.
TOP = ""


def _told(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """H of a row's fields; ``changed`` gives some of them other values."""
    return F.unhex(F.sha2(F.concat(*[_told(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(*digests: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[F.coalesce(_hex(d), F.lit("")) for d in digests]), 256))


def placed(store: Store, df: DataFrame, *order: str) -> DataFrame:
    """df with ``pos``, its place from 0 within its tree, and ``n``, the rows of the tree. Equal rows may change places."""
    ranged = store.put(df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    heads = ranged.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    w = Window.partitionBy("tree")  # a row a range
    heads = heads.select("tree", "part", "first", F.sum("k").over(w).alias("n"), F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.withColumn("part", part).join(small_side(store.put(heads)), ["tree", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _runs(store: Store, nodes: DataFrame, level: int, stride: int, payload: list[str]) -> DataFrame:
    """A row for each run of 2^stride nodes of one level: ``levels``, the digests of its nodes and of what stands above them, and ``steps``, how many these are."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    runs = nodes.groupBy("tree", F.shiftright("pos", stride).alias("run")).agg(F.max("n").alias("n"), members.alias("members"))
    runs = runs.withColumn("steps", F.least(F.lit(stride), height(F.col("n")) - level)).withColumn("base", F.lit(level))

    def raised(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(below) + 1, 1) - 1)
        return F.concat(levels, F.array(F.transform(pairs, lambda i: _parent(F.get(below, 2 * i), F.get(below, 2 * i + 1)))))

    up = F.when(F.col("steps") > 0, F.sequence(F.lit(1), F.col("steps"))).otherwise(F.array().cast("array<int>"))
    return store.put(runs.withColumn("levels", F.aggregate(up, F.array(F.col("members.digest")), raised)))


def _links(runs: DataFrame, stride: int, payload: list[str]) -> DataFrame:
    """The runs' own nodes: where each stands, its ancestor at the run's end, and ``sides``: the siblings to its left and right, level by level."""
    one = runs.select("tree", "run", "n", "steps", "base", "levels", F.explode("members").alias("m"))
    local = (F.col("m.pos") - F.shiftleft(F.col("run"), stride)).cast("int")

    def side(j: Column) -> Column:
        i = F.floor(local / F.pow(F.lit(2), j)).cast("int")
        level = F.get(F.col("levels"), j)
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.get(level, i - 1)).alias("left"), F.when(~odd, F.get(level, i + 1)).alias("right"))

    sides = F.when(F.col("steps") > 0, F.transform(F.sequence(F.lit(0), F.col("steps") - 1), side)).otherwise(F.array().cast("array<struct<left:binary,right:binary>>"))
    # a run that ends below its stride ends at the tree's root, whose place is 0
    return one.select("tree", F.col("base").alias("level"), F.col("m.pos").alias("pos"), (F.col("base") + F.col("steps")).alias("up_level"), F.col("run").alias("up_pos"), sides.alias("sides"), F.col("m.digest").alias("digest"), "n", *[F.col(f"m.{c}").alias(c) for c in payload])


def build(store: Store, leaves: DataFrame, most: int, stride: int = STRIDE, payload: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Links of the nodes of every STRIDE-th level, the leaves' first with the payload columns, and the trees' roots (tree, n, digest).

    leaves: tree, pos, n (leaves of the tree), digest; most: the leaves of the largest tree.
    """
    tall = (most - 1).bit_length() if most > 1 else 0
    links, nodes, extra = [], leaves, list(payload)
    roots: list[DataFrame] = []
    for level in range(0, max(tall, 1), stride):
        runs = _runs(store, nodes, level, stride, extra)
        links.append(_links(runs, stride, extra))
        top = runs.select("tree", "run", "n", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), (height(F.col("n")) <= level + stride).alias("ended"))
        roots.append(top.filter("ended").select("tree", "n", "digest"))
        nodes, extra = top.filter("not ended").select("tree", F.col("run").alias("pos"), "n", "digest"), []
    return links, reduce(DataFrame.unionByName, roots)


_CLIMB = """
WITH RECURSIVE climb(doc_id, leaf, home, tall, tree, level, pos, folded, proof) MAX RECURSION LEVEL 1000 AS (
  SELECT doc_id, leaf, home, tall, tree, level, pos, folded, proof FROM {start}
  UNION ALL
  SELECT {hint} c.doc_id, c.leaf, c.home, c.tall, n.up_tree, n.up_level, n.up_pos,
         aggregate(n.sides, c.folded, (a, s) -> unhex(sha2(concat(coalesce(lower(hex(s.left)), ''), lower(hex(a)), coalesce(lower(hex(s.right)), '')), 256))),
         concat(c.proof, aggregate(n.sides, X'', (a, s) -> concat(a, coalesce(s.left, X''), coalesce(s.right, X''))))
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos)
SELECT * FROM climb WHERE {ended}
"""


def _climb(store: Store, start: DataFrame, nodes: DataFrame, ended: str, broadcast: bool) -> DataFrame:
    """start, taken up as far as nodes lead, stored. Spark's bound on a recursive query's rows is lifted for this query only: it has a row a leaf and step."""
    spark, key = start.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    query = _CLIMB.format(start="{start}", nodes="{nodes}", hint="/*+ BROADCAST(n) */" if broadcast else "", ended=ended)
    spark.conf.set(key, "-1")
    try:
        return store.put(spark.sql(query, start=start, nodes=nodes))
    finally:
        spark.conf.set(key, before)


def manifest(docs: DataFrame, tampered: Column, stride: int = STRIDE, broadcast_rows: int = BROADCAST_ROWS, **changes: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (digests as hex text, level by level), folded_root, verified for every row of docs.

    changes: the values that fields have where ``tampered`` holds; folded_root is climbed from the leaf that they give. verified: whether it is the root.
    """
    store, result = Store(docs.sparkSession, "merkle"), Store(docs.sparkSession, "merkle-result")
    leaf = leaf_digest()
    read = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"), leaf.alias("digest"), F.when(tampered, leaf_digest(**changes)).otherwise(leaf).alias("folded"))
    leaves = store.put(placed(store, store.put(read), "doc_id", "digest"))
    trees = leaves.groupBy("tree").agg(F.max("n").alias("n"))
    most, n_trees, *counts = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*"), *[F.coalesce(F.sum(F.ceil(F.col("n") / (1 << k))), F.lit(0)) for k in range(stride, 61, stride)]).first()
    links, subroots = build(store, leaves, most, stride, ("doc_id", "folded"))
    top_leaves = store.put(placed(store, subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("home"), "digest", height(F.col("n")).alias("tall")), "home"))
    top_links, top_root = build(store, top_leaves, n_trees, stride, ("home", "tall"))
    root = top_root.select("digest").first()
    root_digest = F.lit(bytes(root["digest"]) if root else b"")

    # a language's root climbs on as a leaf of the tree over the roots; if there is only that one, without a sibling
    up = [F.lit(TOP).alias("up_tree"), "up_level", "up_pos", "sides"]
    entry = top_links[0].select(F.col("home").alias("tree"), F.col("tall").alias("level"), F.lit(0).cast("long").alias("pos"), *up)
    above = [entry, *[x.select("tree", "level", "pos", *up) for x in top_links[1:]]]
    inner = [x.select("tree", "level", "pos", F.col("tree").alias("up_tree"), "up_level", "up_pos", "sides") for x in links[1:]]

    # from this level up all nodes together are few
    few = next((i for i in range(len(inner) + 1) if 2 * sum(counts[i : len(inner)]) + 2 * n_trees <= broadcast_rows), None)
    small = few is not None
    few = len(inner) if few is None else few
    low, high = inner[:few], inner[few:]

    start = links[0].select("doc_id", F.col("digest").alias("leaf"), F.col("tree").alias("home"), height(F.col("n")).alias("tall"), "tree", F.col("up_level").alias("level"), F.col("up_pos").alias("pos"), "folded", "sides")
    folded = F.aggregate("sides", F.col("folded"), lambda a, s: _parent(s["left"], a, s["right"]))
    proof = F.aggregate("sides", F.lit(b""), lambda a, s: F.concat(a, F.coalesce(s["left"], F.lit(b"")), F.coalesce(s["right"], F.lit(b""))))
    start = start.withColumn("folded", folded).withColumn("proof", proof).drop("sides")
    if low:
        start = _climb(store, start, store.put(reduce(DataFrame.unionByName, low)), f"level = tall OR level >= {(few + 1) * stride}", False)
    tall_top = (n_trees - 1).bit_length() if n_trees > 1 else 0
    done = _climb(result, start, store.put(reduce(DataFrame.unionByName, above + high)), f"tree = '{TOP}' AND level = {tall_top}", small)
    names = small_side(result.put(subroots.select(F.col("tree").alias("home"), F.col("digest").alias("subroot"))))
    hexed = [_hex(F.col(c)).alias(c) for c in ("leaf", "subroot")]
    store.drop()
    return done.join(names, "home").select("doc_id", *hexed, _hex(root_digest).alias("root"), _hex(F.col("proof")).alias("proof"), _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == root_digest).alias("verified"))
