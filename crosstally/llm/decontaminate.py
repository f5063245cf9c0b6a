"""Benchmark decontamination with suffix arrays over the training text.

Every batch of documents that a task reads is a shard. Its words become numbers, and the suffixes that can match are sorted word by word
into a suffix array by prefix doubling. Every suffix of every benchmark item is looked up there by binary search: the range that it
shares its first ``window`` words with gives all places to be hit, and going on word by word inside the range gives its longest verbatim
match. A shard's words outside the benchmark's vocabulary, and runs of vocabulary words shorter than the shortest window, can't be part
of a match; a suffix ends there.

The benchmark is the query set. It is read in blocks of at most BLOCK_BYTES (text, names and a fixed sum an item); a block is arrays of
numbers and one vocabulary, and it is held against all documents before the next one is read, so neither the driver nor a task ever holds
two. What the blocks before the last one hit is stored in the shared folder, keyed by the text's digest, a row for each different text.

Defined cases: null and empty texts have no words and are never hit; an item of fewer than ``window`` words is one window, an item
without words is none; rows of one item_id are one item, whose windows are those of each row; repeated documents get the same result
each; null item_ids are left out; very long texts are read whole, as a shard of their own; columns other than doc_id, text, item_id are
not read (the filter keeps all columns).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small_side

WINDOW = 10
#: Bytes of benchmark text handled at once, and what an item counts beside its text.
BLOCK_BYTES, ITEM_BYTES = 8_000_000, 100
#: Bytes of document text in a shard.
SHARD_BYTES = 3_000_000

#: Lower-cases A-Z; every ASCII byte that is no digit and no letter becomes a blank.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class Queries:
    """The suffixes of one block of benchmark items: every place of ``ids`` but the zeros between items."""

    def __init__(self, items: Iterator[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary, self.names = window, {}, []
        parts, sizes = [], []
        for name, text in items:
            w = words(text)
            if w:
                parts.append(np.fromiter((self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w), np.int32, len(w)))
                sizes.append(len(w))
                self.names.append(name)
        sizes = np.array(sizes, np.int64)
        ends = np.cumsum(sizes + 1)
        #: Word numbers (0 after each item), and of each item its first place.
        self.ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        self.first = ends - sizes - 1
        for a, p in zip(self.first.tolist(), parts):
            self.ids[a : a + len(p)] = p
        self.longest = int(sizes.max(initial=0))
        left = np.repeat(ends - 1, sizes + 1) - np.arange(len(self.ids))  # words from here to the item's end
        whole = np.repeat(sizes, sizes + 1)
        #: How many words each suffix must share: the window, or the whole of a shorter item; 0 for a suffix that is too short.
        self.need = np.where(left >= window, window, np.where((left == whole) & (left > 0), left, 0)).astype(np.int32)
        self.needs = np.unique(self.need[self.need > 0]).tolist()

    def item_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


@dataclass
class Matches:
    """Of each benchmark suffix that occurs: its place, what it had to share, its range in the suffix array, and its longest match's."""

    suffix: np.ndarray
    need: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    longest_low: np.ndarray
    longest_high: np.ndarray


def _pairs(rank: np.ndarray, places: np.ndarray, step: int, run: np.ndarray) -> np.ndarray:
    """Rank at each place and, behind it, the rank step words on; 0 where the suffix has ended by then."""
    second = np.where(run[places] > step, rank[np.minimum(places + step, len(rank) - 1)], 0)
    return rank[places].astype(np.int64) << 32 | second


class Shard:
    """The suffix array of some texts, as far as their suffixes can match the queries."""

    def __init__(self, texts: list[list[bytes]], queries: Queries):
        self.queries, q = queries, queries
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        #: First place of each text; a 0 follows it.
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.zeros(self.starts[-1] + 1, np.int32)
        for a, t in zip(self.starts.tolist(), texts):
            if t:
                ids[a : a + len(t)] = np.fromiter(map(q.vocabulary.get, t, repeat(0)), np.int32, len(t))
        zeros = np.flatnonzero(ids == 0)
        length = np.diff(zeros, prepend=-1) - 1  # of the run of vocabulary words before each zero
        kept = length >= max(1, q.needs[0] if q.needs else 1)
        end, length = zeros[kept], length[kept]
        places = np.repeat(end, length) - (np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)) - 1
        self.places = np.sort(places)
        self.run = np.zeros(len(ids), np.int32)
        self.run[places] = np.repeat(end, length) - places
        self.rank0 = np.zeros(len(ids), np.int32)
        self.rank0[places] = ids[places]

    def matches(self) -> Matches:
        """Sorts the suffixes by 1, 2, 4 ... words and names the benchmark's word groups of these lengths by the same ranks."""
        q, none = self.queries, np.zeros(0, np.int64)
        rank, ranks, named, places = self.rank0, [], [], self.places
        alive = np.flatnonzero(q.need > 0) if len(places) else none
        name = q.ids if len(places) else q.ids[:0]
        step, found = 1, []
        there = np.zeros(len(q.vocabulary) + 1, bool)
        there[rank[places]] = True
        name = np.where(there[name], name, 0).astype(np.int32)
        while len(places):
            ranks.append(rank)
            named.append(name)
            # windows of step to 2 step - 1 words: a range of the array for those of this length, once it is sorted that far
            keys = _pairs(rank, places, step, self.run)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            value = np.cumsum(fresh, dtype=np.int32)
            if 2 * step > q.longest or not name.any():
                break
            unique = ordered[fresh]
            at = np.flatnonzero(name[: len(name) - step] > 0) if len(name) > step else none
            at = at[name[at + step] > 0]
            wanted = name[at].astype(np.int64) << 32 | name[at + step]
            spot = np.minimum(np.searchsorted(unique, wanted), len(unique) - 1)
            hit = unique[spot] == wanted
            name = np.zeros(len(name), np.int32)
            name[at[hit]] = spot[hit] + 1
            new = np.zeros(len(rank), np.int32)
            new[places[order]] = value
            rank, step = new, 2 * step
        if not len(places):
            return Matches(*[none] * 7)
        array = self.array = places[order]
        for n in q.needs:
            k = n.bit_length() - 1
            if k >= len(ranks):
                continue
            step = n - (1 << k)
            at = alive[q.need[alive] == n]
            at = at[(named[k][at] > 0) & (named[k][at + step] > 0)]
            if not len(at):
                continue
            # along the array these pairs are in order: suffixes that share their first words are sorted by the next ones
            keys = _pairs(ranks[k], array, step, self.run) if step else ranks[k][array].astype(np.int64) << 32
            wanted = named[k][at].astype(np.int64) << 32 | (named[k][at + step] if step else 0)
            low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            some = high > low
            found.append((at[some], np.full(int(some.sum()), n), low[some], high[some]))
        if not found:
            return Matches(*[none] * 7)
        suffix, need, low, high = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        length, a, b = need.copy(), low.copy(), high.copy()
        for k in range(len(ranks) - 1, -1, -1):
            next_ = np.minimum(suffix + length, len(q.ids) - 1)
            wanted = np.where(suffix + length < len(q.ids), named[k][next_], 0)
            go = np.flatnonzero(wanted > 0)
            if len(go):
                lo = self._bound(ranks[k], a[go], b[go], length[go], wanted[go])
                hi = self._bound(ranks[k], lo, b[go], length[go], wanted[go] + 1)
                more = hi > lo
                a[go[more]], b[go[more]] = lo[more], hi[more]
                length[go[more]] += 1 << k
        return Matches(suffix, need, low, high, length, a, b)

    def _bound(self, rank: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First index from low to high whose suffix has, step words on, a rank of at least the wanted one."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            p = self.array[np.minimum(mid, len(self.array) - 1)]
            below = np.where(self.run[p] > step, rank[np.minimum(p + step, len(rank) - 1)], 0) < wanted
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        return low

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def hits(self) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
        """By text: its hit spans (first word, word after the last; merged) and the names of the items that hit it."""
        m = self.matches()
        edge, items = np.zeros(len(self.run) + 1, np.int64), {}
        owner = self.queries.item_of(m.suffix).tolist()
        for n, low, high, item in zip(m.need.tolist(), m.low.tolist(), m.high.tolist(), owner):
            places = self.array[low:high]
            edge[places] += 1
            edge[places + n] -= 1
            for d in np.unique(self.text_of(places)).tolist():
                items.setdefault(d, set()).add(self.queries.names[item])
        covered = np.concatenate(([0], np.cumsum(edge) > 0)).astype(np.int8)
        turn = np.flatnonzero(np.diff(covered))
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, a, z in zip(self.text_of(turn[::2]).tolist(), turn[::2].tolist(), turn[1::2].tolist()):
            spans.setdefault(d, []).append((int(a - self.starts[d]), int(z - self.starts[d])))
        return {d: (s, sorted(items[d])) for d, s in spans.items()}

    def longest(self, doc_ids: list[int]) -> Iterator[tuple]:
        """(item, first item word, length, doc_id, first document word): of the places of each suffix's longest match that with the smallest doc_id and word."""
        m, ids = self.matches(), np.array(doc_ids, np.int64)
        owner = self.queries.item_of(m.suffix)
        for item, s, n, low, high in zip(owner.tolist(), m.suffix.tolist(), m.length.tolist(), m.longest_low.tolist(), m.longest_high.tolist()):
            places = self.array[low:high]
            text = self.text_of(places)
            best = np.lexsort((places - self.starts[text], ids[text]))[0]
            yield self.queries.names[item], int(s - self.queries.first[item]), n, int(ids[text[best]]), int(places[best] - self.starts[text[best]])


class Blocks:
    """The benchmark in blocks of about block_bytes, read one at a time; rows of one item_id are never parted."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        self.window, self.items = window, benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
        total = self.items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item_id") + ITEM_BYTES)).first()[0] or 0
        self.n = max(1, ceil(total / block_bytes))

    def read(self, k: int) -> Queries:
        block = self.items if self.n == 1 else self.items.filter(F.pmod(F.xxhash64("item_id"), F.lit(self.n)) == k)
        return Queries(((r["item_id"], r["text"]) for r in block.toLocalIterator()), self.window)


def _shards(texts: list) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > SHARD_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_SPANS = "array<struct<first:bigint,after:bigint>>"


def hits_column(text: Column, queries: Queries) -> Column:
    """struct(n_words, n_hit, spans, items) of whole texts for one block."""

    @F.pandas_udf(f"n_words long, n_hit long, spans {_SPANS}, items array<string>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, rows = b.tolist(), []
            for i, j in _shards(texts):
                split = [words(t) for t in texts[i:j]]
                found = Shard(split, queries).hits()
                for d, w in enumerate(split):
                    spans, items = found.get(d, ((), ()))
                    rows.append((len(w), sum(z - a for a, z in spans), [{"first": a, "after": z} for a, z in spans], list(items)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items"])

    return hits(text)


def _text_hits(docs: DataFrame, queries: Queries) -> DataFrame:
    """digest (SHA-256 of the text), spans, items: a stored row for each different text that one block hits. Copies are one row before they move."""
    hit = docs.select(F.col("text"), hits_column(F.col("text"), queries).alias("h")).filter("h.n_hit > 0")
    return cut(hit.select(F.sha2("text", 256).alias("digest"), "h.spans", "h.items").groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))


def _merged(spans: Column) -> Column:
    """Sorted spans, those that touch made one."""

    def join(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["after"], s["after"]).alias("after"))
        return F.when(F.coalesce(s["first"] <= last["after"], F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), join)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, spans, contaminated for every row of docs(doc_id, text).

    With one block no row is shuffled. With several, what the others hit is stored first and joined by the digest of the text.
    """
    blocks = Blocks(benchmark, window, block_bytes)
    others = [_text_hits(docs, blocks.read(k)) for k in range(blocks.n - 1)]
    rows = docs.select("doc_id", F.sha2("text", 256).alias("digest"), hits_column(F.col("text"), blocks.read(blocks.n - 1)).alias("h"))
    told = rows.select("doc_id", "digest", "h.n_words", "h.n_hit", "h.spans", F.col("h.items").alias("item_ids"))
    if others:
        more = reduce(DataFrame.unionByName, others).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
        told = told.join(more, "digest", "left")
        told = told.withColumn("spans", _merged(F.concat("spans", F.coalesce("more_spans", F.array().cast(_SPANS)))))
        told = told.withColumn("item_ids", F.array_sort(F.array_distinct(F.concat("item_ids", F.coalesce("more_items", F.array().cast("array<string>"))))))
        told = told.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"]))
    return told.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that no window hits. Texts move only if several blocks hit very many different texts."""
    blocks = Blocks(benchmark, window, block_bytes)
    name = fresh(docs, "hit_digest")
    others = [_text_hits(docs, blocks.read(k)).select(F.col("digest").alias(name)) for k in range(blocks.n - 1)]
    clean = docs.filter(hits_column(F.col("text"), blocks.read(blocks.n - 1))["n_hit"] == 0)
    if not others:
        return clean
    return clean.join(small_side(reduce(DataFrame.unionByName, others)), F.sha2(clean["text"], 256) == F.col(name), "left_anti")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, item_word, length, doc_id, doc_word: over all shards the longest verbatim match of each test suffix that shares its window, and one place of it.

    Of equally long matches the one with the smallest doc_id and then the smallest word is told; rows with a null doc_id are left out.
    """
    out, best = None, F.max_by(F.struct("length", "doc_id", "doc_word"), F.struct("length", -F.col("doc_id"), -F.col("doc_word")))
    blocks = Blocks(benchmark, window, block_bytes)
    for k in range(blocks.n):
        q = blocks.read(k)

        def matches(batches: Iterator[pd.DataFrame], q: Queries = q) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts, names = b["text"].tolist(), b["doc_id"].tolist()
                for i, j in _shards(texts):
                    rows = list(Shard([words(t) for t in texts[i:j]], q).longest(names[i:j]))
                    yield pd.DataFrame(rows, columns=["item_id", "item_word", "length", "doc_id", "doc_word"])

        part = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(matches, "item_id string, item_word long, length long, doc_id long, doc_word long")
        part = cut(part.groupBy("item_id", "item_word").agg(best.alias("best")).select("item_id", "item_word", "best.*"))
        out = part if out is None else out.unionByName(part)
    return out


def digest_of_items(item_ids: Column) -> Column:
    """sha256 of the names, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(item_ids)), 256)
