"""Jaccard join of word n-gram sets by prefix filters under several global orders.

Two sets of Jaccard similarity t or more share at least one of the first floor((1 - t) * n) + 1 tokens of either, whatever order all
tokens stand in. So a pair has to share a prefix token under every one of several different orders; what two orders let through is
intersected before any set is compared.

An order puts the tokens of one range of a hash first, the rarest of them first: how many different sets hold a token is counted exactly,
over all documents, but only in that range, which holds twice as many tokens as the prefix. Most documents have enough tokens of their own there to fill their
prefix, and end there. The second order has its range at the other end of the hash and is counted among what the first one left; only for
those documents whole sets are made and kept. Tokens that are frequent already inside a task stand after the others of the range, by their
count (at most FREQUENT of them, so the list has a bound; any list gives a right order); all others stand last, by hash.

Equal sets are one class from the start. A prefix group brings together classes with a signature each: parities of how many tokens fall on
each bit, which differ in at most as many bits as the sets do in tokens (tokens that the same classes hold make one group). Pairs of fitting sizes whose signatures allow a link, and that
share a prefix token under the second order too, are compared in three steps: twice one partner of each class that it isn't joined with, which joins
most copies; then all such pairs that aren't joined yet. Large groups are dealt into pairs of blocks. So no link is lost, and
of a group of copies only those pairs leave it that are near the threshold and not linked by others.

Sets, classes and tokens are told apart by 64-bit hashes: among 10^9 different texts the chance of one mistaken equality is some 3 %.

Defined cases: null, empty and blank texts have an empty set and a component of their own; fewer words than a shingle are one shingle; rows
with a null doc_id get their size and a null component; repeated rows stay repeated, and rows of one doc_id with different texts are documents of their own; very long
texts are read whole; an empty table has no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, long_rows, small_side
from .simhash import components

SHINGLE, PERCENT = 3, 90
#: The share of tokens whose frequency an order counts, as a range of the hash: so many times the prefix.
RANGE = 2
#: Tokens that a task counts at once, how often one must be there to be told, and the most that are told to all tasks.
COUNTED, OFTEN, FREQUENT = 1_000_000, 3, 131_072
#: Words whose hashes a task remembers.
KNOWN_WORDS = 100_000
#: Beyond this a token's count doesn't matter any more.
MANY = 1000
#: Classes of a block in a prefix group, and tokens of the sets that are compared with one class in one group.
BLOCK, GROUP_TOKENS = 2048, 65_536
#: The most bits of a set's signature.
SIGNED_BITS = 4096
_U = np.uint64


def _mixed(h: np.ndarray, add: np.ndarray | int, odd: int) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(odd) + add
    return h ^ (h >> _U(29))


class Shingles:
    """Sets of word n-grams as sorted 64-bit numbers; words are hashed once."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.known = n, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, _U)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 7)
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        k = min(self.n, len(words))
        out = np.full(len(words) - k + 1, 0x9E3779B97F4A7C15 + k, _U)
        for i in range(k):
            out = _mixed(out, h[i : len(words) - k + 1 + i], 0xC2B2AE3D27D4EB4F)
        return np.unique(_mixed(out, 0, 0x165667B19E3779F9))


def class_of(tokens: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(tokens.tobytes(), len(tokens)), _U).astype(np.int64))


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parities of how many tokens fall on each bit, of 4 to 8 a token and SIGNED_BITS at most: two signatures differ in at most as many bits as the sets do in tokens."""
    bits = min(SIGNED_BITS, max(64, 1 << int(4 * len(tokens) - 1).bit_length()))
    return np.packbits((np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(_U)


def folded(signatures: np.ndarray) -> np.ndarray:
    """The same of half as many bits."""
    half = signatures.shape[-1] // 2
    return signatures[..., :half] ^ signatures[..., half:]


def prefix_size(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    return (100 - percent) * n // 100 + 1


def turned(tokens: np.ndarray, order: int) -> np.ndarray:
    """Sorted tokens as another order's sorted numbers: the second has the hash upside down, later ones are mixed anew."""
    if order == 1:
        return tokens
    return ~tokens[::-1] if order == 2 else np.sort(_mixed(tokens, order, 0xD6E8FEB86659FD93))


def edge(percent: int) -> np.uint64:
    """Where the counted range of the hash ends."""
    return _U(min(2**64 - 1, RANGE * (100 - percent) * 2**64 // 100))


_READ = "doc_id long, node long, n long, low binary, full binary, sig binary, token long, k long"


def read(docs: DataFrame, order: int, full: bool, shingle: int, percent: int) -> DataFrame:
    """Of every row: class (null without words), size, and once in a task for each class the start of its tokens in this order, and all of them if asked.

    Beside these a row for each token of the order's range that is frequent in the task. The start is the range's tokens, and as many as the prefix at least.
    """
    least = -(-percent // (100 - percent)) if percent < 100 else 1  # smaller sets link with their equals only

    fields = [("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("low", pa.binary()), ("full", pa.binary()), ("sig", pa.binary()), ("token", pa.int64()), ("k", pa.int64())]

    def made(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(rows, kind) for c, kind in fields], names=[c for c, _ in fields])

    end = edge(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, told, counted, size = Shingles(shingle), set(), [], 0

        def frequent() -> pa.RecordBatch:
            tokens, k = np.unique(np.concatenate([np.zeros(0, _U), *counted]), return_counts=True)
            return made(token=tokens[k >= OFTEN].view(np.int64), k=k[k >= OFTEN])

        for b in batches:
            nodes, sizes, lows, wholes, sigs = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                tokens = shingles.of(text)
                node, low, whole, sig = class_of(tokens) if len(tokens) else None, None, None, None
                if len(tokens) >= least and doc_id is not None and node not in told:
                    told.add(node)
                    start = turned(tokens, order)
                    inside = int(np.searchsorted(start, end))
                    start = start[: max(inside, prefix_size(len(tokens), percent))]
                    low = start.tobytes()
                    if full:
                        whole, sig = tokens.tobytes(), signature(tokens).tobytes()
                    counted.append(start[:inside])
                    size += inside
                nodes.append(node)
                sizes.append(len(tokens))
                lows.append(low)
                wholes.append(whole)
                sigs.append(sig)
            yield made(doc_id=b.column("doc_id"), node=nodes, n=sizes, low=lows, full=wholes, sig=sigs)
            if len(told) > 500_000:
                told.clear()
            if size > COUNTED:
                yield frequent()
                counted, size = [], 0
        yield frequent()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _READ)


def frequent_tokens(found: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most so many tokens, sorted, with the logarithm of their counts: the most frequent ones."""
    counted = found.filter("token is not null").groupBy("token").agg(F.floor(F.log2(F.sum("k"))).cast("int").alias("level"))
    levels = sorted(((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)  # 64 at most
    least, total = 64, 0
    for level, n in levels:
        total += n
        if total > most:
            break
        least = level
    rows = counted.filter(F.col("level") >= least).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(_U)
    by = np.argsort(tokens)
    return tokens[by], rows["level"].to_numpy(np.int64)[by]


class Order:
    """Where a token stands: (0, its count) in the range, (1, level) if it is frequent there, and (2,) outside; ties by hash."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT):
        self.tokens, self.levels = frequent
        self.edge = edge(percent)

    def level(self, tokens: np.ndarray) -> np.ndarray:
        """The level of a frequent token, else -1."""
        if not len(self.tokens):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.levels[at], -1)

    def sent(self, start: np.ndarray, p: int) -> np.ndarray:
        """Of the start of a set, what can be in its prefix of p tokens: all that must be counted, or the prefix itself."""
        inside = int(np.searchsorted(start, self.edge))
        level = self.level(start[:inside])
        rare = start[:inside][level < 0]
        if len(rare) >= p:
            return rare
        often = np.flatnonzero(level >= 0)
        often = start[:inside][often[np.argsort(level[often], kind="stable")]]
        return np.concatenate([rare, often, start[inside:]])[:p]

    def place(self, tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
        level = self.level(tokens)
        inside = tokens < self.edge
        return np.where(~inside, 2 << 32, np.where(level >= 0, (1 << 32) + level, count))


def _runs(order: Order):
    """Of sorted rows (token, node): those of tokens that several nodes have, with the token's place in the order."""

    def told(tokens: np.ndarray, nodes: np.ndarray, count: np.ndarray) -> pd.DataFrame:
        several = count > 1
        tokens = tokens[several].view(_U)
        return pd.DataFrame({"node": nodes[several], "token": tokens.view(np.int64), "place": order.place(tokens, np.minimum(count[several], MANY))})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, n, long = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b in batches:
            t, n = np.concatenate([t, b["token"].to_numpy(np.int64)]), np.concatenate([n, b["node"].to_numpy(np.int64)])
            keep = np.r_[True, (t[1:] != t[:-1]) | (n[1:] != n[:-1])][: len(t)]
            t, n = t[keep], n[keep]
            ends = int(np.searchsorted(t, t[-1])) if len(t) else 0  # where the last run begins
            if ends:
                first = np.flatnonzero(np.r_[True, t[1:ends] != t[: ends - 1]])
                size = np.diff(np.r_[first, ends])
                yield told(t[:ends], n[:ends], np.where(t[:ends] == long, MANY, np.repeat(size, size)) if long is not None else np.repeat(size, size))
                t, n = t[ends:], n[ends:]
            if len(t) > 2 * MANY:  # a long run: all but its last row can go on
                long = t[0]
                yield told(t[:-1], n[:-1], np.full(len(t) - 1, MANY))
                t, n = t[-1:], n[-1:]
        if len(t):
            yield told(t, n, np.full(len(t), MANY if t[0] == long else len(t)))

    return rows


def prefixes(found: DataFrame, order: Order, percent: int) -> DataFrame:
    """(token, node, n): the prefix tokens that several classes send, of the classes that have such."""
    starts = found.filter("low is not null").select("node", "n", "low")

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [order.sent(np.frombuffer(x, _U), prefix_size(n, percent)) for x, n in zip(b["low"], b["n"])]
            sizes = [len(p) for p in parts]
            for i, j in _slices(sizes, 200_000):
                yield pd.DataFrame({"token": np.concatenate(parts[i:j]).view(np.int64), "node": np.repeat(b["node"].to_numpy(np.int64)[i:j], sizes[i:j])})

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = prefix_size(b["n"].to_numpy(np.int64), percent)
            e = np.array([len(order.sent(np.frombuffer(x, _U), int(k))) for x, k in zip(b["low"], p)], np.int64)
            yield pd.DataFrame({"node": b["node"], "n": b["n"], "spare": p - e})

    rows = starts.mapInPandas(sent, "token long, node long").repartition("token").sortWithinPartitions("token", "node")
    shared = rows.mapInPandas(_runs(order), "node long, token long, place long")
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("tokens"))  # bounded by the set
    spare = starts.mapInPandas(sizes, "node long, n long, spare long").groupBy("node").agg(F.first("n").alias("n"), F.first("spare").alias("spare"))
    # tokens that nobody shares come first, so the prefix holds this many of the others
    take = F.col("spare") + F.size("tokens")
    kept = own.join(spare, "node").filter(take > 0)
    return kept.select("node", "n", F.explode(F.slice("tokens", 1, take.cast("int"))).alias("t")).select(F.col("t.token").alias("token"), "node", "n")


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, k in enumerate(sizes):
        if i > start and total + k > most:
            yield start, i
            start, total = i, 0
        total += k
    if start < len(sizes):
        yield start, len(sizes)


def _fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _shared(pairs: DataFrame, later: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix token of the later order too."""
    held = later.groupBy("node").agg(F.collect_list("token").alias("tokens"))  # a class's own prefix
    of = lambda c: held.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(F.arrays_overlap("tokens_a", "tokens_b")).select(*pairs.columns)


def _different(groups: DataFrame, percent: int) -> DataFrame:
    """The rows of prefix groups that have another of fitting size there, of groups with different members only: tokens that the same classes hold are as one."""
    members = groups.groupBy("token").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (1, 2)]).filter("k > 1")
    first = members.groupBy("k", "m1", "m2").agg(F.min("token").alias("token")).select("token")
    w = Window.partitionBy("token").orderBy("n", "node")  # by size, the one before or the one after
    near = [F.coalesce(_fits(F.col("n"), f("n").over(w), percent), F.lit(False)) for f in (F.lag, F.lead)]
    return groups.join(first, "token").select("*", (near[0] | near[1]).alias("near")).filter("near").drop("near")


def _near(i: int, j: int, nodes: list, ns: list, cs: list, owns: list, sigs: list, percent: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the blocks i and j of one group that aren't joined, fit in size and whose signatures allow a link: all, or for each one partner in every 256."""
    ns, cs, owns = np.array(ns), np.array(cs), np.array(owns)
    words = np.array([len(x) // 8 for x in sigs])
    for size in np.unique(words).tolist():
        same, twice = np.flatnonzero(words == size), np.flatnonzero(words == 2 * size)
        bits = np.stack([np.frombuffer(sigs[x], _U) for x in same])
        others, more = (np.concatenate([same, twice]), np.concatenate([bits, folded(np.stack([np.frombuffer(sigs[x], _U) for x in twice]))])) if len(twice) else (same, bits)
        if len(others) < 2:
            continue
        for k in range(0, len(same), 256):
            x, y = same[k : k + 256, None], others[None, :]
            ok = (cs[x] != cs[y]) & (100 * np.minimum(ns[x], ns[y]) >= percent * np.maximum(ns[x], ns[y]))
            ok &= ((owns[x] == i) & (owns[y] == j)) | ((owns[x] == j) & (owns[y] == i))
            ok &= (np.arange(k, k + len(x))[:, None] < np.arange(len(others))[None, :])
            p, q = np.nonzero(ok)
            for a in range(0, len(p), 100_000):
                u, v = p[a : a + 100_000], q[a : a + 100_000]
                apart = np.bitwise_count(bits[k + u] ^ more[v]).sum(1, dtype=np.int64)
                # of n + m tokens at most so many may be in one set only
                fine = apart * (100 + percent) <= (100 - percent) * (ns[same[k + u]] + ns[others[v]])
                u, v = u[fine], v[fine]
                if not every:
                    v, first = np.unique(v, return_index=True)
                    u = u[first]
                if len(u):
                    yield same[k + u], others[v]


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every class in the pairs (a, b) that with its smallest partner."""
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.r_[True, x[1:] != x[:-1]][: len(x)]
    return np.minimum(x[first], y[first]), np.maximum(x[first], y[first])


def _candidates(groups: DataFrame, signed: DataFrame, joined: DataFrame, percent: int, block: int, every: bool) -> DataFrame:
    """(a, b): pairs that share a prefix token, aren't joined, fit in size and whose signatures allow a link; a large group is dealt into pairs of blocks.

    ``every``: all of them; else one partner for each class.
    """
    rows = groups.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    size = rows.groupBy("token").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token", F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    met = rows.join(size, "token").join(signed, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    lists = met.groupBy("token", "i", "j").agg(*[F.collect_list(x).alias(f"{x}s") for x in ("node", "n", "c", "own", "sig")])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, j, nodes, *rest in zip(*[batch.column(x).to_pylist() for x in ("i", "j", "nodes", "ns", "cs", "owns", "sigs")]):
                if len(nodes) == 2 and (rest[1][0] == rest[1][1] or 100 * min(rest[0]) < percent * max(rest[0])):
                    continue
                nodes = np.array(nodes)
                near = [(nodes[u], nodes[v]) for u, v in _near(i, j, nodes, *rest, percent, every)]
                if near and not every:
                    near = [_smallest(*map(np.concatenate, zip(*near)))]
                found += near
            u, v = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    found = lists.select("i", "j", "nodes", "ns", "cs", "owns", "sigs").mapInArrow(pairs, "a long, b long").distinct()
    if every:
        return found
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")
    one = found.select(ends).groupBy("e.x").agg(F.min("e.y").alias("y"))  # of a class only its smallest partner, so links stay as few as classes
    return one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A set is sent once to each of its partners' groups; a class with many partners has several groups."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("full").alias("set")), "b")
    sizes = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b").groupBy("a").agg(F.ceil(F.sum("n_b") / GROUP_TOKENS).cast("int").alias("parts"))
    members = with_b.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "set", F.lit(False).alias("own"))
    owns = sizes.join(sets.select(F.col("node").alias("a"), F.col("full").alias("set")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), "set", F.lit(True).alias("own"))

    met = members.unionByName(owns).groupBy("a", "part").agg(F.max(F.when(F.col("own"), F.col("set"))).alias("whole"), F.collect_list(F.when(~F.col("own"), F.struct("b", "set"))).alias("others"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for own, whole, others in zip(batch.column("a").to_pylist(), batch.column("whole").to_pylist(), batch.column("others").to_pylist()):
                whole = np.frombuffer(whole, _U)
                near = [x["b"] for x in others if similar(whole, np.frombuffer(x["set"], _U), percent)]
                a += [own] * len(near)
                b += near
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.select("a", "whole", "others").mapInArrow(alike, "a long, b long")


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Store]:
    """The rows (doc_id, node, n) of docs, (node, component) of all classes with a link, and the store of both."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession
    long_rows(spark, 500)
    work, result = Store(spark, "jaccard"), Store(spark, "jaccard-result")
    found = work.put(read(docs, 1, False, shingle, percent))
    rows = result.put(found.filter("n is not null").select("doc_id", "node", "n"))
    first = work.put(prefixes(found, Order(frequent_tokens(found), percent), percent))
    # whole sets only of the documents that have something left to share
    wanted = work.put(found.filter("low is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(first.select("node").distinct(), "node", "left_semi"))
    again = docs.select("doc_id", "text").join(small_side(wanted.select(F.col("doc_id").alias("wanted_id")).distinct()), F.col("doc_id") == F.col("wanted_id"), "left_semi")
    sets = work.put(read(again, 2, True, shingle, percent))
    second = work.put(prefixes(sets.join(small_side(wanted.select("node")), "node", "left_semi"), Order(frequent_tokens(sets), percent), percent))
    groups = work.put(_different(first.join(second.select("node").distinct(), "node", "left_semi"), percent))
    sets = work.put(sets.filter("full is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("full").alias("full"), F.first("sig").alias("sig")))
    edges, joined = [], spark.createDataFrame([], "node long, component long")
    for every in (False, False, True):
        pairs = _shared(_candidates(groups, sets.select("node", "sig"), joined, percent, block, every), second)
        edges.append(work.put(_compared(work.put(pairs), sets, percent)))
        joined = result.put(components(reduce(DataFrame.unionByName, edges)))
    work.drop()
    return rows, joined, result


def near_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text): component_id is the smallest doc_id reachable by links."""
    rows, joined, result = classes(docs, shingle, percent, block)
    known = rows.filter("doc_id is not null")
    # a document is linked with its class; equal sets meet here
    least = known.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = least.join(least.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("node", "component_id")
    out = rows.join(least, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
