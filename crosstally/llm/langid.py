"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector is the product of its letters' vectors, each rolled by its
place (binding of permuted vectors); a document's vector is the sum of its trigrams' vectors (bundling), a language's prototype
the sum of its training documents' unit vectors. A document gets the language whose prototype has the largest cosine.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; rows with a null language teach nothing; with no
teaching row at all every text is ``und``; equal cosines go to the language that sorts first; equal texts get equal results; texts of any
length are read whole, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DIMENSIONS = 1024
#: Letters share so many random vectors; code points beyond are folded by remainder.
SLOTS = 4096
SEED = 20260101
#: Bound of the training sample: documents of each language.
MAX_DOCS_PER_LANG = 3000
#: Texts bundled at once.
ROWS = 512
#: Code points, and different trigrams, handled at once inside a task.
CHUNK_CHARS, GRAMS = 300_000, 8192

#: Letters from which a text is long enough to be judged by the pipeline's rule, and the steps in which that rule's cosines are counted.
LETTERS, STEPS = 200, 10_000
#: Five times the spread of the cosine of unrelated vectors.
CHANCE = 5 / DIMENSIONS**0.5

_tables: dict = {}


def _letter_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Slot of each code point (0: no letter), and the slots' vectors rolled by 2, 1 and 0. Made once in each Python worker."""
    if not _tables:
        slot = np.fromiter(((1 + i % (SLOTS - 1)) if chr(i).isalpha() else 0 for i in range(0x110000)), np.int32, 0x110000)
        signs = np.random.default_rng(SEED).integers(0, 2, (SLOTS, DIMENSIONS), dtype=np.int8) * 2 - 1
        _tables["slot"], _tables["rolled"] = slot, [np.roll(signs, r, axis=1) for r in (2, 1, 0)]
    return _tables["slot"], _tables["rolled"]


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str, int, int]]]:
    """Chunks of (row, lower-cased piece, its context before, behind). A long text is cut into pieces, each with the letters beside it as context."""
    chunk, size = [], 0
    for row, t in enumerate(texts):
        t = t.lower()
        for a in range(0, max(1, len(t)), CHUNK_CHARS):
            b = min(len(t), a + CHUNK_CHARS)
            before, behind = int(a > 0), int(b < len(t))
            if chunk and (size + b - a > CHUNK_CHARS or len(chunk) >= 128):
                yield chunk
                chunk, size = [], 0
            chunk.append((row, t[a - before : b + behind], before, behind))
            size += b - a
    if chunk:
        yield chunk


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of DIMENSIONS per text, the sum of its trigrams' vectors, and its letters. Trigrams lie inside words, which have a blank on either side; each letter is the middle of one.

    A bundle is a sum, so it is added up over pieces of at most CHUNK_CHARS and, within one, over GRAMS different trigrams at a time:
    memory depends on neither a text's length nor its number of different trigrams.
    """
    out, letters = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts), np.int64)
    for chunk in _pieces(texts):
        rows = np.array([c[0] for c in chunk])
        vectors, n = _bundle_chunk(chunk)
        np.add.at(out, rows, vectors)
        np.add.at(letters, rows, n)
    return out, letters


def _bundle_chunk(chunk: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    slot, rolled = _letter_tables()
    points = np.frombuffer(("\n" + "\n".join(c[1] for c in chunk) + "\n").encode("utf-32-le", "replace"), np.uint32)
    n_points = np.array([len(c[1]) + 1 for c in chunk])
    owner = np.concatenate(([0], np.repeat(np.arange(len(chunk), dtype=np.int32), n_points)))
    s = slot[points]
    centre = s != 0
    start = np.cumsum(n_points) - n_points + 1
    centre[start[np.array([c[2] for c in chunk]) > 0]] = False
    centre[(start + n_points - 2)[np.array([c[3] for c in chunk]) > 0]] = False
    out = np.zeros((len(chunk), DIMENSIONS))
    mid = np.flatnonzero(centre)
    owner = owner[mid]
    letters = np.bincount(owner, minlength=len(chunk))
    if not len(mid):
        return out, letters
    used = np.flatnonzero(np.bincount(s, minlength=SLOTS))
    dense = np.zeros(SLOTS, np.int64)
    dense[used] = np.arange(len(used))
    c, n = dense[s], len(used)
    code = (c[mid - 1] * n + c[mid]) * n + c[mid + 1]
    if n**3 <= 4_000_000:
        there = np.flatnonzero(np.bincount(code, minlength=n**3))
        place = np.zeros(n**3, np.int32)
        place[there] = np.arange(len(there), dtype=np.int32)
        col = place[code]
    else:
        there, col = np.unique(code, return_inverse=True)
    order = np.argsort(col, kind="stable") if len(there) > GRAMS else None
    for a in range(0, len(there), GRAMS):
        g = there[a : a + GRAMS]
        if order is None:
            here, of = col, owner
        else:
            part = order[np.searchsorted(col, a, "left", sorter=order) : np.searchsorted(col, a + GRAMS, "left", sorter=order)]
            here, of = col[part] - a, owner[part]
        grams = (rolled[0][used[g // (n * n)]] * rolled[1][used[g // n % n]] * rolled[2][used[g % n]]).astype(np.float32)
        counts = np.bincount(of * len(g) + here, minlength=len(chunk) * len(g)).reshape(len(chunk), len(g))
        out += counts.astype(np.float32) @ grams
    return out, letters


@dataclass
class Profiles:
    langs: list[str]
    vectors: np.ndarray  # unit rows


def fit_profiles(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs_per_lang: int | None = MAX_DOCS_PER_LANG) -> Profiles:
    """Prototypes from about max_docs_per_lang rows of each language (whole texts, chosen by the hash of the key), or from all rows if that is None.

    What reaches the driver is one vector for each language.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    some = rows
    if max_docs_per_lang is not None:
        share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, max_docs_per_lang / v)))])
        some = rows.filter(F.pmod(F.xxhash64("key", F.lit("profile")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts = b["text"].tolist()
            for i in range(0, len(texts), ROWS):
                v, _ = bundle(texts[i : i + ROWS])
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v /= np.where(norm > 0, norm, 1)
                part = b["lang"].to_numpy()[i : i + ROWS]
                for k in set(part):
                    sums[k] = sums.get(k, 0) + v[part == k].sum(0)
        for k, v in sums.items():
            yield pd.DataFrame({"lang": k, "at": np.arange(DIMENSIONS), "x": v})

    sums = some.select("lang", "text").mapInPandas(bundled, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum(F.round("x", 6)).alias("x")).collect()
    langs = sorted(n)
    vectors = np.zeros((len(langs), DIMENSIONS))
    row = {k: i for i, k in enumerate(langs)}
    for r in sums:
        vectors[row[r["lang"]], r["at"]] = r["x"]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles(langs, (vectors / np.where(norm > 0, norm, 1)).astype(np.float32))


def predict_language(text: Column, profiles: Profiles) -> Column:
    """struct(lang_pred, score, margin, letters): the language with the largest cosine, that cosine (0 at least), what it is above the next one, and the text's letters."""
    langs, vectors = np.array([*profiles.langs, "und"], dtype=object), profiles.vectors

    @F.pandas_udf("lang_pred string, score double, margin double, letters long")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["" if t is None else t for t in b]
            best, score, margin, letters = np.full(len(texts), len(langs) - 1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i in range(0, len(texts), ROWS):
                at = slice(i, i + ROWS)
                v, letters[at] = bundle(texts[at])
                if len(langs) == 1:
                    continue
                norm = np.linalg.norm(v, axis=1)
                cosine = (v @ vectors.T) / np.where(norm > 0, norm, 1)[:, None]
                some = norm > 0
                best[at] = np.where(some, np.argmax(cosine, axis=1), len(langs) - 1)
                ordered = np.clip(np.sort(cosine, axis=1), 0, 1)
                score[at] = np.where(some, ordered[:, -1], 0)
                margin[at] = np.where(some, ordered[:, -1] - (ordered[:, -2] if len(langs) > 2 else 0), 0)
            yield pd.DataFrame({"lang_pred": langs[best], "score": score, "margin": margin, "letters": letters})

    return predicted(text)


@dataclass
class Rule:
    """What keeps a document: see in_stated_language."""

    score: float  # least cosine of a text of LETTERS letters or more
    margin: float  # from which a prediction is sure


def learn_rule(rows: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> Rule:
    """From all rows whose language is known and told rightly, of LETTERS letters or more: half of the cosine, and of the margin, that 99 of
    100 of them reach; and of the cosine CHANCE at least, which unrelated texts hardly reach. Both are counted in steps of 1 / STEPS, so a count is small."""
    known = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter((F.col("lang").isNotNull()) & (F.length("text") >= LETTERS))
    told = known.select("lang", predict_language(F.col("text"), profiles).alias("p")).filter((F.col("p.lang_pred") == F.col("lang")) & (F.col("p.letters") >= LETTERS))
    low = told.agg(*[(F.percentile(F.floor(F.col(f"p.{c}") * STEPS), 0.01) / STEPS).alias(c) for c in ("score", "margin")]).first()
    return Rule(max(CHANCE, (low["score"] or 0.0) / 2), (low["margin"] or 0.0) / 2)


def in_stated_language(lang: Column, predicted: Column, rule: Rule) -> Column:
    """Whether a document stays: it has a letter and a language; it is like that language, if it is long enough to tell; and it isn't surely in another language than the one it states."""
    p = predicted
    told = (p["lang_pred"] != "und") & (p["score"] > 0)
    like = (p["letters"] < LETTERS) | (p["score"] >= rule.score)
    other = lang.isNotNull() & (lang != p["lang_pred"]) & (p["letters"] >= LETTERS) & (p["margin"] >= rule.margin)
    return told & like & ~other
