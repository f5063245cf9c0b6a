"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are cut into two pieces of 31 bits and two bits that no piece has. Two fingerprints with at most three
differing bits differ in at most one bit of one of the pieces. Over 31 bits the code words of the perfect Hamming code (31, 26) are
the anchors: every piece has exactly one within one bit (covering radius 1). A fingerprint is sent to every anchor within radius +
threshold = 2 bits of its piece - one anchor for a code word, sixteen for any other piece - so two linked fingerprints meet at an
anchor that is the nearest one of either. Fingerprints that meet are compared there on all 64 bits.

Equal fingerprints are merged first. An anchor with many fingerprints is compared in blocks: its fingerprints are dealt into blocks
of about BLOCK, and each pair of blocks is a group of its own, so no group is unbounded and none is left out. A group gives the
edges of a spanning forest, never all its pairs. Components come from alternating large-star and small-star steps.

Defined cases: null text, empty text and text of white space have fingerprint zero and link like any other; fewer than three words
are one shingle; rows with a null doc_id get a fingerprint and a null component; repeated rows stay repeated; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, cut, fresh, named

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Fingerprints of a block at an anchor.
BLOCK = 2048
#: Shingles whose bits are counted at once.
_COUNTED = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])] if len(words) > shingle else [0]
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _COUNTED):
        ones += np.unpackbits(hashes[i : i + _COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed bigint."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.fromiter((fingerprint(t, shingle) for t in b), np.uint64, len(b)).view(np.int64))

    return prints(text)


def _syndrome(piece: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the set bits: 0 for a code word, else the place whose flip gives the nearest code word."""
    s = np.zeros(len(piece), np.int64)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        s |= (np.bitwise_count(piece & mask).astype(np.int64) & 1) << k
    return s


def anchors_of(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 31-bit pieces: row, anchor and whether it is the nearest one, for every anchor within two bits."""
    s = _syndrome(piece)
    flip = lambda place: np.where(place > 0, 1 << np.maximum(place - 1, 0), 0)
    rows, found, home = [np.arange(len(piece))], [piece ^ flip(s)], [np.ones(len(piece), bool)]
    for i in range(1, 32):
        j = s ^ i
        ok = np.flatnonzero((s > 0) & (j > i))  # the two flipped places XOR to the syndrome; each pair once
        rows.append(ok)
        found.append(piece[ok] ^ flip(np.full(len(ok), i)) ^ flip(j[ok]))
        home.append(np.zeros(len(ok), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _replicated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 20_000):
            fp, node = b["fp"].to_numpy(np.int64)[i : i + 20_000], b["node"].to_numpy(np.int64)[i : i + 20_000]
            for k in (0, 1):
                row, anchor, home = anchors_of((fp >> (31 * k)) & 0x7FFFFFFF)
                yield pd.DataFrame({"anchor": anchor + (k << 31), "fp": fp[row], "node": node[row], "home": home.astype(np.int32)})


def spanning_edges(fps: np.ndarray, nodes: np.ndarray, home: np.ndarray | None = None, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links inside one group that have an end at home there, found breadth first.

    Two fingerprints that are both away from home meet at an anchor that is the home of one of them, so they aren't compared here.
    """
    fps = fps.view(np.uint64)  # counts of signed numbers would be those of their absolute values
    home = np.ones(len(fps), bool) if home is None else np.asarray(home, bool)
    edges: list[tuple[int, int]] = []

    def reached(front: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each of left one of front that is near enough, or -1."""
        near = np.full(len(left), -1, np.int64)
        for i in range(0, len(front), 256):
            part = front[i : i + 256]
            close = np.bitwise_count(fps[part][:, None] ^ fps[left][None, :]) <= threshold
            hit = close.any(0) & (near < 0)
            near[hit] = part[close[:, hit].argmax(0)]
        return near

    # fingerprints at home not reached yet, and the others; every tree begins at home, as every link has an end there
    inside, outside = np.flatnonzero(home), np.flatnonzero(~home)
    while len(inside):
        front, inside = inside[:1], inside[1:]
        while len(front):
            near_in = reached(front, inside)
            at_home = front[home[front]]
            near_out = reached(at_home, outside) if len(at_home) else np.full(len(outside), -1, np.int64)
            new_in, new_out = near_in >= 0, near_out >= 0
            edges += zip(nodes[near_in[new_in]].tolist(), nodes[inside[new_in]].tolist())
            edges += zip(nodes[near_out[new_out]].tolist(), nodes[outside[new_out]].tolist())
            front = np.concatenate([inside[new_in], outside[new_out]])
            inside, outside = inside[~new_in], outside[~new_out]
    return edges


def links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what links, of distinct (fp, node) rows."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two covered pieces find at most three differing bits")
    sent = prints.select("fp", "node").mapInPandas(_replicated, "anchor long, fp long, node long, home int")
    size = sent.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("home").alias("homes")).filter("n > 1 and homes > 0").select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = sent.join(size, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("anchor", "fp", "node", "home", "own", other.alias("other")).select("anchor", "fp", "node", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("fp", "node", "home")]
    groups = met.groupBy("anchor", "i", "j").agg(*lists).filter((F.size("fps") > 1) & F.array_contains("homes", 1))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edges = [e for f, n, h in zip(b["fps"], b["nodes"], b["homes"]) for e in spanning_edges(np.asarray(f, np.int64), np.asarray(n, np.int64), np.asarray(h), threshold)]
            yield pd.DataFrame(edges or None, columns=["a", "b"], dtype="int64")

    return groups.select("fps", "nodes", "homes").mapInPandas(compared, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Alternating stars: each step rewires every node to the smallest of its neighbours, until nothing changes; long chains take a
    number of steps that grows with the logarithm of their length. Each step is stored, so the lineage stays short.
    """
    small = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    last = mark(small)
    while last[0]:
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
        now = mark(small)
        if now == last:
            break
        last = now
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (bigint), component_id for every row of docs(doc_id, text)."""
    marked = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), shingle).alias("fp")))
    distinct = cut(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(distinct, threshold, block))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in kept(doc_id); all columns stay, whatever their names.

    Rows that repeat a doc_id are one document, of which one row stays: that with the smallest SHA-256 of its text (null first), then with
    the smallest hash of its other columns. Rows with a null doc_id stay. Winners are chosen among digests; texts move
    once, unsorted, for any number of ids. Only rows that are equal in all of this are numbered.
    """
    others = [f.name for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    digest, rest = F.sha2("text", 256), F.xxhash64(*[named(c) for c in others])
    k, d, h, n = (fresh(docs, x) for x in ("kept_id", "kept_digest", "kept_hash", "kept_rows"))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias(k), digest.alias(d), rest.alias(h)).groupBy(k, d, h).agg(F.count("*").alias(n))
    best = rows.groupBy(k).agg(F.min_by(F.struct(d, h, n), F.struct(d, h)).alias("x")).select(k, f"x.{d}", f"x.{h}", f"x.{n}")
    best = Store(docs.sparkSession, "kept").put(best.join(kept.select(F.col("doc_id").alias(k)), k, "left_semi"))

    def of(winners: DataFrame) -> DataFrame:
        return docs.join(winners.hint("shuffle_hash"), (F.col("doc_id") == F.col(k)) & digest.eqNullSafe(F.col(d)) & (rest == F.col(h)), "left_semi")

    out = of(best.filter(F.col(n) == 1))
    if best.filter(F.col(n) > 1).limit(1).count():
        number = fresh(docs, "kept_number")
        equal = of(best.filter(F.col(n) > 1)).withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(1))))
        out = out.unionByName(equal.filter(F.col(number) == 1).drop(number))
    return out.unionByName(docs.filter("doc_id is null"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; all columns stay, and of an id one row, as keep_first says."""
    return keep_first(docs, near_duplicates(docs, **options).filter("doc_id = component_id").select("doc_id"))
