"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score is linear in features of the line and of its neighbours (make-up of the characters, repeated
words, repeated lines, length), and neighbouring labels have a transition score. Forward and backward passes give each line's
marginal probability of being good; a document's quality is their mean, weighted by the lines' lengths.

Training labels are those of documents: each line of a training document bears its document's label. The sample is bounded by
MAX_DOCS documents and their first MAX_LINES lines; scoring reads every line of every text.

Defined cases: null, empty and blank texts have no line and score 0; without training rows of both labels every other text scores
the share of label 1 (0.5 without any); equal texts get equal scores; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash

#: Bounds of the training sample: documents, and the lines of all of them together.
MAX_DOCS, MAX_LINES = 3000, 150_000
THRESHOLD = 0.3
CHUNK_BYTES = 1_000_000

_OWN = 14
#: The line's own features that a neighbour sees too.
_SHARED = (1, 2, 3, 4, 6, 7)
N_FEATURES = _OWN + 2 * (len(_SHARED) + 1)


def _byte_classes() -> np.ndarray:
    """1 letter, 2 digit, 3 other printed sign, 4 usual punctuation; 0 for white space and controls."""
    t = np.zeros(256, np.uint8)
    t[33:127] = 3
    t[48:58] = 2
    t[65:91] = t[97:123] = t[128:] = 1
    t[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    return t


_CLASS = _byte_classes()
_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(8).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, owning text and length (bytes) of every line that has a printed sign, in order."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    owner_end = np.cumsum([len(t) + 1 for t in texts])
    end = np.flatnonzero(buffer == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    kind = _CLASS[buffer]
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate((start, [len(buffer)]))])
    printed = total(kind > 0)
    live = printed > 0
    if not live.any():
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters, digits, signs, points = (total(kind == k) for k in (1, 2, 3, 4))
    upper = total((buffer >= 65) & (buffer <= 90))
    bars = total(buffer == ord("|"))
    # words and their hashes
    inside = kind > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    place = np.arange(len(buffer)) - np.maximum.accumulate(np.where(first, np.arange(len(buffer)), 0))
    mixed = np.where(inside, _MIX[buffer] * _PLACE[place & 63], np.uint64(0))
    word = np.add.reduceat(mixed, at) * np.uint64(0x9E3779B97F4A7C15)
    line_of = np.searchsorted(end, at)
    n = len(end)
    words = np.bincount(line_of, minlength=n)
    again = np.zeros(len(at), bool)
    again[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    keyed = word ^ (line_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(keyed, kind="stable")
    same = np.zeros(len(at), bool)
    same[1:] = keyed[order][1:] == keyed[order][:-1]
    repeated = np.bincount(line_of[order[same]], minlength=n)
    adjacent = np.bincount(line_of[again], minlength=n)
    # lines seen before in their text
    owner = np.searchsorted(owner_end, start, "right")
    whole = np.zeros(n, np.uint64)
    rank = np.arange(len(at)) - np.searchsorted(line_of, line_of)
    np.add.at(whole, line_of, word * _PLACE[rank & 63])
    keyed = whole ^ (owner.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    order = np.argsort(keyed, kind="stable")
    seen = np.zeros(n, bool)
    seen[order[1:]] = keyed[order][1:] == keyed[order][:-1]
    last_sign = np.maximum.accumulate(np.where(kind > 0, np.arange(len(buffer)), 0))[end]
    p, w = np.maximum(printed, 1), np.maximum(words, 1)
    own = np.stack(
        [np.ones(n), np.log1p(printed) / 5, letters / p, signs / p, repeated / w, adjacent / w, bars / w, (signs > 0.02 * p), digits / p, points / p, upper / p, np.minimum(printed / w, 20) / 10, seen, kind[last_sign] == 4], axis=1
    ).astype(np.float32)[live]
    owner = owner[live]
    near = []
    for step in (1, -1):
        there = np.zeros(len(own), bool)
        rolled = np.zeros((len(own), len(_SHARED)), np.float32)
        a, b = (slice(1, None), slice(None, -1)) if step == 1 else (slice(None, -1), slice(1, None))
        there[a] = owner[a] == owner[b]
        rolled[a] = own[b][:, _SHARED]
        near += [rolled * there[:, None], there[:, None].astype(np.float32)]
    return np.concatenate([own, *near], axis=1), owner, printed[live]


@dataclass
class LineField:
    weights: np.ndarray  # score of good over bad, linear in the features
    moves: np.ndarray  # transition scores, [from][to], 0 bad and 1 good
    otherwise: float = 0.5  # score of a text with lines if nothing could be learned
    slope: float = 1.0  # of the score's log odds over the aggregate's
    shift: float = 0.0


def _step(x: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log odds of the next label from those of this one."""
    return np.logaddexp(x + moves[1, 1], moves[0, 1]) - np.logaddexp(x + moves[1, 0], moves[0, 0])


def _ragged(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines and the texts that have lines, longest first."""
    ids, first, n = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    return first[order], n[order], ids[order]


def marginals(unary: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward log odds, backward log odds and P(good) of each line; all texts advance together, line by line."""
    first, n, _ = _ragged(owner)
    ahead, back = unary.copy(), np.zeros_like(unary)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than t lines come first
    for t in range(1, longest):
        i = first[: active[t]] + t
        ahead[i] += _step(ahead[i - 1], moves)
    turned = moves.T
    for t in range(longest - 1, 0, -1):
        i = first[: active[t]] + t
        back[i - 1] = _step(back[i] + unary[i], turned)
    return ahead, back, 1 / (1 + np.exp(-np.clip(ahead + back, -50, 50)))


def fit_field(x: np.ndarray, owner: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.1, l2: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient ascent (Adam); label is per line."""
    w, m = np.zeros(x.shape[1]), np.zeros((2, 2))
    g1, g2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    y = label.astype(np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pair], y[pair + 1]), 1)
    for k in range(1, rounds + 1):
        unary = x @ w
        ahead, back, p = marginals(unary, owner, m)
        u = np.stack([np.zeros(len(pair)), ahead[pair]], 1)[:, :, None] + m[None] + np.stack([np.zeros(len(pair)), (unary + back)[pair + 1]], 1)[:, None, :]
        u = np.exp(u - u.max((1, 2), keepdims=True))
        expected = (u / u.sum((1, 2), keepdims=True)).sum(0)
        grad = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(y) - l2 * np.concatenate([w, m.ravel()])
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        step = rate * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.99**k)) + 1e-8)
        w, m = w + step[:-4], m + step[-4:].reshape(2, 2)
    return LineField(w, m)


def aggregate(p: np.ndarray, length: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the marginals of each of n texts; 0 without a line."""
    weight = np.bincount(owner, length, minlength=n)
    return np.where(weight > 0, np.bincount(owner, p * length, minlength=n) / np.maximum(weight, 1), 0.0)


def _odds(mean: np.ndarray) -> np.ndarray:
    m = np.clip(mean, 1e-9, 1 - 1e-9)
    return np.log(m / (1 - m))


def fit_curve(mean: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """slope (0 at least) and shift of P(label 1) over the aggregate's log odds, by Newton steps; targets are drawn in from 0 and 1 by one made-up document of each label, so that separable samples have an answer."""
    x, good = _odds(mean), label == 1
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    z = np.stack([x, np.ones(len(x))], 1)
    centre, spread = x.mean(), max(x.std(), 1e-6)
    z[:, 0] = (x - centre) / spread
    w = np.zeros(2)

    def loss(w: np.ndarray) -> float:
        s = z @ w
        return float((np.logaddexp(0, s) - target * s).sum() + 1e-3 * w @ w)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z.T * (q * (1 - q))) @ z + 2e-3 * np.eye(2), z.T @ (target - q) - 2e-3 * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(w[0], 0.0) / spread
    return float(slope), float(w[1] - slope * centre)


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> LineField:
    """Fits on at most max_docs of labels(doc_id, quality), with at most max_lines lines in all. Features are made by Spark's tasks."""
    some = sample_by_hash(labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", max_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bound: max_docs ids
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)) + 1
    sized = texts.groupBy("doc_id").agg(F.sum(lines).alias("n")).orderBy(F.xxhash64(F.col("doc_id"), F.lit("sample")), "doc_id").collect()  # bound: max_docs rows
    fits, left = [], max_lines
    for r in sized:
        if r["n"] <= left:
            fits.append(r["doc_id"])
            left -= r["n"]
    taken = docs.sparkSession.createDataFrame([(i,) for i in fits], "doc_id long")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in b["text"]]
            x, owner, length = line_features(raw)
            rows = [(owner == i) for i in range(len(raw))]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "n": [int(r.sum()) for r in rows], "x": [x[r].tobytes() for r in rows], "length": [length[r].astype(np.int64).tobytes() for r in rows]})

    made = texts.join(F.broadcast(taken), "doc_id", "left_semi").mapInPandas(features, "doc_id long, quality int, n int, x binary, length binary")  # bound: max_docs ids
    rows = sorted(made.filter("n > 0").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    if len({r["quality"] for r in rows}) < 2:
        return LineField(np.zeros(N_FEATURES), np.zeros((2, 2)), float(rows[0]["quality"]) if rows else 0.5)
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]).astype(np.float64)
    length = np.concatenate([np.frombuffer(r["length"], np.int64) for r in rows])
    owner, label = np.repeat(np.arange(len(rows)), [r["n"] for r in rows]), np.array([r["quality"] for r in rows])
    field = fit_field(x, owner, label[owner])
    field.slope, field.shift = fit_curve(aggregate(marginals(x @ field.weights, owner, field.moves)[2], length, owner, len(rows)), label)
    return field


def quality_column(text: Column, field: LineField) -> Column:
    """struct(score, n_lines, n_bad, aggregate): P(label 1), the lines and those likelier bad than good, and the length-weighted mean of the marginals."""
    learned = bool(field.weights.any())

    def scored(texts: list[bytes]) -> np.ndarray:
        x, owner, length = line_features(texts)
        p = marginals(x @ field.weights, owner, field.moves)[2] if learned else np.full(len(owner), field.otherwise)
        n = np.bincount(owner, minlength=len(texts))
        mean = aggregate(p, length, owner, len(texts))
        score = 1 / (1 + np.exp(-np.clip(field.slope * _odds(mean) + field.shift, -50, 50))) if learned else mean
        return np.stack([np.where(n > 0, score, 0.0), n, np.bincount(owner, (p < 0.5).astype(float), minlength=len(texts)), mean], 1)

    @F.pandas_udf("score double, n_lines long, n_bad long, aggregate double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, parts, start, size = [(t or "").encode("utf-8", "replace") for t in b], [np.zeros((0, 4))], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > CHUNK_BYTES or i == len(texts) - 1:
                    parts.append(scored(texts[start : i + 1]))
                    start, size = i + 1, 0
            v = np.concatenate(parts)
            yield pd.DataFrame({"score": np.clip(v[:, 0], 0, 1), "n_lines": v[:, 1].astype(np.int64), "n_bad": v[:, 2].astype(np.int64), "aggregate": v[:, 3]})

    return quality(text)
