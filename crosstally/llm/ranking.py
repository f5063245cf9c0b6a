"""Ranked lexical search with document FP-trees and branch and bound.

A first pass reads every text once and keeps its vector restricted to the items' terms: term numbers and occurrences, and the count of all
its terms. Those rows are stored; the corpus counts (documents, terms, documents that hold a term) come from them. A second pass makes an
FP-tree of the vectors that a task holds, CHUNK_ENTRIES at a time: terms ordered from the most frequent on, so documents share paths from
the root. A node keeps, over the documents below it, the largest tf of each of their terms and the smallest m. Scores rise with tf and fall
with m, so the score of a document that had both is a bound of all of them. The tree is searched depth first, likeliest child first, for all
items at once; an item goes down into a node only while its bound beats what the item has found, and ends at documents, whose
scores are exact. A task gives at most ``k`` rows an item; these meet in two rounds, so a common item is no single task's work.

The items are the query set. They are read in blocks of at most BLOCK_BYTES, one at a time; a block is held against all documents before
the next one is read.

Defined cases: null and empty texts, and texts without a term, count neither as documents nor in any sum and are never found; an item
without a term, or whose terms no document holds, has no rows; rows of one item_id are one item with the terms of each; null item_ids are
left out; a document with a null doc_id is ranked, after its equals; repeated rows are documents of their own; very long texts are read
whole; empty tables give no rows; columns other than doc_id, text, item_id are not read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store
from .decontaminate import words

TOP = 10
#: The formula's whole numbers: tf and length are weighed in thousandths.
SCALE, B, LENGTH = 1000, 90, 8
#: Bytes of item text handled at once, and what an item counts beside its text.
BLOCK_BYTES, ITEM_BYTES = 8_000_000, 200
#: Terms of the documents that one tree holds.
CHUNK_ENTRIES = 1_000_000
_NO_ID = np.iinfo(np.int64).max


def gain(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What a term that occurs tf times adds, before its weight."""
    return (SCALE * SCALE * SCALE * tf) // (SCALE * tf + LENGTH * m)


class Items:
    """One block of items: their names, the terms they hold as numbers, and which items hold each term."""

    def __init__(self, rows: Iterator[tuple[str, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[str, set[int]] = {}
        for name, text in rows:
            terms = {self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)}
            held.setdefault(name, set()).update(terms)
        self.names = list(held)
        self.terms = [np.fromiter(sorted(held[n]), np.int64) for n in self.names]


class Postings:
    """The items by term, terms numbered from the most frequent on."""

    def __init__(self, items: Items, df: dict[int, int], n_docs: int, length: int):
        known = sorted(df, key=lambda t: (-df[t], t))
        self.rank = np.full(len(items.vocabulary), -1, np.int64)
        self.rank[known] = np.arange(len(known))
        self.weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in known], np.int64)
        of = np.repeat(np.arange(len(items.names)), [len(t) for t in items.terms])
        terms = self.rank[np.concatenate(items.terms)] if items.terms else np.zeros(0, np.int64)
        of, terms = of[terms >= 0], terms[terms >= 0]
        order = np.argsort(terms, kind="stable")
        self.items = of[order]
        self.first = np.searchsorted(terms[order], np.arange(len(known) + 1))
        self.names, self.n_docs, self.length = items.names, n_docs, length

    def scores(self, terms: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        """Of every item: the score of a document with these terms."""
        first, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        # sums of whole numbers far below 2^53 are exact
        return np.bincount(self.items[at], np.repeat(self.weight[terms] * gain(tf, m), size), len(self.names)).astype(np.int64)


class Best:
    """The best documents of every item so far, and what one more must beat: a higher score, or the same and a smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.score, self.key = np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def beaten(self, scores: np.ndarray, key: int, among: np.ndarray) -> np.ndarray:
        s, least = scores[among], self.score[among]
        return among[(s > least) | (s == least) & (key < self.key[among])]

    def add(self, scores: np.ndarray, key: int, among: np.ndarray) -> None:
        for i in self.beaten(scores, key, among).tolist():
            rows = self.rows[i]
            insort(rows, (-int(scores[i]), key))
            if len(rows) > self.k:
                rows.pop()
            if len(rows) == self.k:
                self.score[i], self.key[i] = -rows[-1][0], rows[-1][1]


class Node:
    """A node of the FP-tree: the largest tf of each term below it, the smallest m and the smallest key; a document has no children."""

    __slots__ = ("terms", "tf", "m", "key", "depth", "children")

    def __init__(self, terms: np.ndarray | None, tf: np.ndarray | None, m: int, key: int, depth: int, children: list[Node]):
        self.terms, self.tf, self.m, self.key, self.depth, self.children = terms, tf, m, key, depth, children

    def close(self) -> Node:
        """The maxima and minima of what hangs below."""
        terms, tf = np.concatenate([c.terms for c in self.children]), np.concatenate([c.tf for c in self.children])
        order = np.argsort(terms, kind="stable")
        terms, tf = terms[order], tf[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        self.terms, self.tf = terms[first], np.maximum.reduceat(tf, first) if len(first) else tf
        self.m, self.key = min(c.m for c in self.children), min(c.key for c in self.children)
        return self


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def fp_tree(documents: list[Node]) -> Node:
    """The tree of documents whose terms are in frequency order; a node for each path that several share, with the longest path that they do."""
    documents.sort(key=lambda d: (d.terms.astype(">u4").tobytes(), d.m, d.key))
    open_ = [Node(None, None, 0, 0, 0, [])]
    for d, after in zip(documents, [*documents[1:], None]):
        depth = _shared(d.terms, after.terms) if after else 0
        if depth > open_[-1].depth:
            open_.append(Node(None, None, 0, 0, depth, [d]))
            continue
        open_[-1].children.append(d)
        while depth < open_[-1].depth:
            done = open_.pop().close()
            if open_[-1].depth < depth:
                open_.append(Node(None, None, 0, 0, depth, [done]))
            else:
                open_[-1].children.append(done)
    return open_[0].close()


def search(tree: Node, postings: Postings, best: Best) -> int:
    """Depth first, for all items at once; how many documents were scored."""
    waiting, scored = [(tree, np.arange(len(postings.names)))], 0
    while waiting:
        node, among = waiting.pop()
        bounds = postings.scores(node.terms, node.tf, node.m)
        if not node.children:
            best.add(bounds, node.key, among)
            scored += 1
            continue
        among = best.beaten(bounds, node.key, among)
        if len(among):
            # the child with the most to give is searched first
            waiting += [(c, among) for c in sorted(node.children, key=lambda c: -c.m)]
    return scored


def _chunks(rows: Iterator[tuple], entries: int) -> Iterator[list[tuple]]:
    chunk, size = [], 0
    for r in rows:
        if chunk and size + len(r[2]) > entries:
            yield chunk
            chunk, size = [], 0
        chunk.append(r)
        size += len(r[2])
    if chunk:
        yield chunk


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (the items' terms that the text holds) of every row."""
    vocabulary = items.vocabulary

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                found = words(text)
                known = [vocabulary[w] for w in found if w in vocabulary]
                terms, tfs = np.unique(np.array(known, np.int32), return_counts=True)
                rows.append((doc_id, len(found), terms, tfs.astype(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(counted, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best_of_tasks(stored: DataFrame, postings: Postings, k: int, entries: int) -> DataFrame:
    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(postings.names), k)
        rows = (r for b in batches for r in zip(b["doc_id"], b["n"], b["terms"], b["tfs"]))
        for chunk in _chunks(rows, entries):
            documents = []
            for doc_id, n, terms, tfs in chunk:
                ranks = postings.rank[np.asarray(terms, np.int64)]
                order = np.argsort(ranks)
                m = 100 - B + (B * int(n) * postings.n_docs) // postings.length
                documents.append(Node(ranks[order], np.asarray(tfs, np.int64)[order], m, _NO_ID if pd.isna(doc_id) else int(doc_id), 0, []))
            search(fp_tree(documents), postings, best)
        rows = [(postings.names[i], None if key == _NO_ID else key, -score) for i, found in enumerate(best.rows) for score, key in found]
        out = pd.DataFrame(rows, columns=["item_id", "doc_id", "score"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out

    return stored.filter(F.size("terms") > 0).mapInPandas(searched, "item_id string, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, entries: int = CHUNK_ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents of docs(doc_id, text) with the highest scores above 0."""
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType
    queries = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = queries.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item_id") + ITEM_BYTES)).first()[0] or 0
    n_blocks, counts, found = max(1, ceil(total / block_bytes)), None, []
    store, result = Store(spark, "ranking"), Store(spark, "ranking-result")
    for b in range(n_blocks):
        block = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        items = Items((r["item_id"], r["text"]) for r in block.toLocalIterator())
        stored = store.put(vectors(docs, items))
        counts = counts or stored.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # a row for each of the block's terms at most
        df = {r["t"]: r["k"] for r in stored.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("k")).collect()}
        rows = _best_of_tasks(stored, Postings(items, df, *counts), k, entries)
        found.append(result.put(rows))
    store.drop()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
