"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - threshold_k) for k = 1, 2, 3: one weight vector, ordered thresholds. x is sparse: log(1 + count) of
words and word beginnings (three and five letters) from a vocabulary of those that stand out most in toxic documents. Expected severity is the sum of the three probabilities.

Labels are 0 or 1, so the grades of toxic training documents come from how dense their telling words are: thirds of the training
documents' density (1 mild, 2 clear, 3 dense). Telling words are those far more usual in toxic documents (log odds over 3) and surely so
(z over 10); where no word is, as in small samples, those with at least half of the largest z. The grades so rest on words that are features
too: they order toxic documents by how much of the text is toxic, and are no independent judgement. The vocabulary, the grades and the fit
use a sample bounded by MAX_DOCS; scoring reads whole texts.

Defined cases: where toxic training documents have equal densities they all have grade 1; null, empty and wordless texts have no feature and the expected severity of the intercepts; without training rows of
both labels severity is 0 and nothing is toxic; equal texts get equal results; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash

MAX_DOCS, MAX_WORDS, MIN_DOCS = 8000, 3000, 5
GRADES = 3
#: P(grade >= 1) from which a document counts as toxic.
THRESHOLD = 0.4
#: Words whose features a worker remembers.
MEMO = 150_000

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def _names(word: bytes) -> list[str]:
    """The features of a word: itself and, where it is longer, its first three and five letters."""
    w = word.decode("utf-8", "replace")
    return [w, *("^" + w[:n] for n in (3, 5) if len(w) > n)]


def _counts(text: str | None, place: dict[str, int], memo: dict[bytes, tuple[int, ...]]) -> tuple[Counter, int]:
    """How often each feature of the vocabulary occurs in a text, and the text's words. memo: the features of words met before."""
    words, out = _words(text), Counter()
    if len(memo) > MEMO:
        memo.clear()
    for w, n in Counter(words).items():
        if (at := memo.get(w)) is None:
            at = memo[w] = tuple(place[x] for x in _names(w) if x in place)
        for i in at:
            out[i] += n
    return out, len(words)


def _distinct_names(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({x for w in set(_words(t)) for x in _names(w)}), na_action=None)

    return distinct(text)


@dataclass
class Severity:
    place: dict[str, int]  # word or word beginning to its weight's place
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= GRADES) in columns."""
        if not len(self.thresholds):
            return np.zeros((len(score), GRADES))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest posterior: standard normal weights, so the penalty fades as rows come in. Thresholds are a first one and exponentials of gaps, so they stay in order."""
    w, gaps = np.zeros(width), np.array([2.0, 0.0, 0.0][:GRADES])
    g1, g2 = np.zeros(width + GRADES), np.zeros(width + GRADES)
    n = len(grade)
    l2 = 1 / max(n, 1)
    for k in range(1, rounds + 1):
        theta = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
        score = np.bincount(rows, values * w[cols], minlength=n)
        c = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -50, 50))), np.zeros((n, 1))], 1)
        p = np.maximum(c[np.arange(n), grade] - c[np.arange(n), grade + 1], 1e-9)
        slope = c * (1 - c)  # derivative of each cumulative probability by the score
        d_score = (slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p
        d_theta = np.array([(((grade == j - 1).astype(float) - (grade == j)) * slope[:, j] / p).sum() for j in range(1, GRADES + 1)])
        d_gaps = np.concatenate(([d_theta.sum()], [d_theta[j:].sum() * np.exp(gaps[j]) for j in range(1, GRADES)]))
        grad = np.concatenate([np.bincount(cols, values * d_score[rows], minlength=width) / n - l2 * w, d_gaps / n])
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        step = rate * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.99**k)) + 1e-8)
        w, gaps = w + step[:width], gaps + step[width:]
    return w, gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> Severity:
    """Fits on at most max_docs of labels(doc_id, toxic): those with the smallest hash of their id."""
    some = sample_by_hash(labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", max_docs)
    sample = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bound: max_docs ids
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Severity({}, np.zeros(0), np.zeros(0))
    seen = sample.select("toxic", F.explode(_distinct_names(F.col("text"))).alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    seen = seen.filter(F.col("all") >= min_docs)
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (n[0] + 1))
    told = seen.withColumn("odds", odds).withColumn("z", odds * F.sqrt("all")).filter("z > 0").orderBy(F.desc("z"), "word").limit(max_words).collect()
    place = {r["word"]: i for i, r in enumerate(told)}
    z = np.array([r["z"] for r in told] or [0.0])
    telling = np.array([r["odds"] > 3 for r in told] or [False]) & (z > 10)
    if not telling.any():
        telling = z >= max(z.max() / 2, 1e-9)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            rows = []
            for doc, toxic, text in zip(b["doc_id"], b["toxic"], b["text"]):
                c, n_words = _counts(text, place, memo)
                rows.append((doc, toxic, n_words, sorted(c), [c[i] for i in sorted(c)]))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "n", "at", "count"])

    rows = sorted(sample.mapInPandas(counted, "doc_id long, toxic int, n int, at array<int>, count array<int>").collect(), key=lambda r: (r["doc_id"], r["n"], r["at"], r["count"]))
    owner = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    cols = np.array([i for r in rows for i in r["at"]], np.int64)
    values = np.array([c for r in rows for c in r["count"]], float)
    toxic = np.array([r["toxic"] for r in rows])
    density = np.bincount(owner, values * telling[cols], minlength=len(rows)) / np.maximum([r["n"] for r in rows], 1)
    thirds = np.quantile(density[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (density > thirds[0]) + (density > thirds[1]), 0)
    w, theta = fit_ordinal(owner, cols, np.log1p(values), grade, max(1, len(told)))
    return Severity(place, w, theta)


def toxicity_column(text: Column, model: Severity) -> Column:
    """struct(severity, p_toxic, grade): expected grade, P(grade >= 1), and the likeliest grade."""

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            score = np.zeros(len(b))
            for i, t in enumerate(b):
                found = _counts(t, model.place, memo)[0] if t else {}
                at = np.fromiter(sorted(found), np.int64, len(found))
                score[i] = model.weights[at] @ np.log1p([found[k] for k in at.tolist()]) if len(at) else 0.0
            p = model.probabilities(score)
            each = np.concatenate([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]], 1)
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0], "grade": each.argmax(1).astype(np.int32)})

    return toxicity(text)
