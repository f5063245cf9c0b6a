"""Quality, toxicity and language ID: methods against brute force, accuracy on rows held out, awkward rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstally.llm import langid, quality, toxicity
from crosstally.llm.common import id_remainder, table

from .helpers import ENGLISH, FRENCH, documents, empty

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string"


# --- quality


def brute_marginals(unary, moves):
    """P(good) of each line by summing over all labellings."""
    n = len(unary)
    total, good = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(u for u, k in zip(unary, y) if k) + sum(moves[a, b] for a, b in zip(y, y[1:]))
        total += np.exp(s)
        good += np.exp(s) * np.array(y)
    return good / total


def test_marginals_match_brute_force():
    rng = np.random.default_rng(1)
    lengths = [1, 6, 3, 8, 2]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    unary, moves = rng.normal(size=len(owner)), rng.normal(size=(2, 2))
    p = quality.marginals(unary, owner, moves)[2]
    for k, _ in enumerate(lengths):
        assert p[owner == k] == pytest.approx(brute_marginals(unary[owner == k], moves))


def test_fit_follows_the_gradient():
    """The fitted field is likelier than its neighbours in every direction tried."""
    rng = np.random.default_rng(2)
    owner = np.repeat(np.arange(40), 5)
    y = rng.integers(0, 2, 200)
    x = np.stack([np.ones(200), y + rng.normal(size=200)], 1)
    f = quality.fit_field(x, owner, y, rounds=600, rate=0.05)

    def loss(w, m):
        total = -0.5e-3 * 200 * (w @ w + (m * m).sum())
        for k in range(40):
            u, yy = (x @ w)[owner == k], y[owner == k]
            scores = {z: sum(a for a, b in zip(u, z) if b) + sum(m[a, b] for a, b in zip(z, z[1:])) for z in itertools.product((0, 1), repeat=5)}
            total += scores[tuple(yy.tolist())] - np.log(sum(np.exp(s) for s in scores.values()))
        return total

    best = loss(f.weights, f.moves)
    for _ in range(6):
        assert loss(f.weights + 0.05 * rng.normal(size=2), f.moves + 0.05 * rng.normal(size=(2, 2))) <= best + 1e-3


def test_features_of_lines():
    x, owner, length = quality.line_features([b"a b a\n\n| x |\n", b"", b"Zz zz\nZz zz\nend."])
    assert owner.tolist() == [0, 0, 2, 2, 2] and length.tolist() == [3, 3, 4, 4, 4]
    assert x[0, 4] == pytest.approx(1 / 3) and x[1, 6] == pytest.approx(2 / 3)  # repeated words, bars
    assert x[:, 12].tolist() == [0, 0, 0, 1, 0]  # the second "Zz zz" was seen before
    assert x[4, 13] == 1 and x[0, -1] == 1 and x[1, -1] == 0  # ends with a full stop; has a next line


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    field = quality.train_quality(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0))
    rows = docs.join(labels, "doc_id").filter(id_remainder(F.col("doc_id"), 5) == 0).select("quality", quality.quality_column(F.col("text"), field)["score"].alias("s")).collect()
    good, bad = [r["s"] for r in rows if r["quality"]], [r["s"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= quality.THRESHOLD for g in good]) > 0.97


def test_quality_awkward_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    field = quality.train_quality(docs, labels, max_docs=200)
    rows = documents(spark).select("doc_id", "text", quality.quality_column(F.col("text"), field).alias("q")).collect()
    assert len(rows) == documents(spark).count() and all(0 <= r["q"]["score"] <= 1 for r in rows)
    assert all(r["q"]["score"] == 0 and r["q"]["n_lines"] == 0 for r in rows if not (r["text"] or "").strip())
    assert len({r["q"]["score"] for r in rows if r["text"] == rows[0]["text"]}) == 1
    none = quality.train_quality(docs, labels.filter("false"))
    assert documents(spark).select(quality.quality_column(F.col("text"), none)["score"].alias("s")).filter("s not in (0, 0.5)").count() == 0
    assert empty(spark).select(quality.quality_column(F.col("text"), field)).count() == 0


# --- toxicity


def test_ordinal_recovers_order():
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.exponential(size=n)
    grade = np.clip(np.floor(x + 0.3 * rng.logistic(size=n)), 0, 3).astype(int)
    w, theta = toxicity.fit_ordinal(np.arange(n), np.zeros(n, int), x, grade, 1)
    assert w[0] > 1 and list(theta) == sorted(theta)
    p = toxicity.Severity({}, w, theta).probabilities(w[0] * x)
    assert (np.diff(p, axis=1) <= 0).all()
    assert np.corrcoef(p.sum(1), grade)[0, 1] > 0.8


def test_toxicity_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))  # smaller tables have too few toxic rows
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train_toxicity(docs, labels.filter(~held))
    rows = docs.join(labels, "doc_id").filter(held).select("toxic", toxicity.toxicity_column(F.col("text"), model).alias("t")).collect()
    toxic = [r["t"]["p_toxic"] >= toxicity.THRESHOLD for r in rows if r["toxic"]]
    clean = [r["t"]["p_toxic"] >= toxicity.THRESHOLD for r in rows if not r["toxic"]]
    assert np.mean(clean) < 0.01 and np.mean(toxic) > 0.88
    assert np.mean([r["t"]["severity"] for r in rows if r["toxic"]]) > 5 * np.mean([r["t"]["severity"] for r in rows if not r["toxic"]])


def test_toxicity_awkward_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train_toxicity(docs, labels)
    rows = documents(spark).select("doc_id", "text", toxicity.toxicity_column(F.col("text"), model).alias("t")).collect()
    assert len(rows) == documents(spark).count() and len({r["t"]["severity"] for r in rows if not (r["text"] or "").strip()}) == 1
    none = toxicity.train_toxicity(docs, labels.filter("toxic = 0"))
    assert documents(spark).select(toxicity.toxicity_column(F.col("text"), none)["severity"].alias("s")).filter("s <> 0").count() == 0
    assert empty(spark).select(toxicity.toxicity_column(F.col("text"), model)).count() == 0


# --- language ID


def brute_bundle(text):
    slot, rolled = langid._letter_tables()
    v = np.zeros(langid.DIMENSIONS)
    word = []
    for c in text.lower() + " ":
        s = slot[ord(c)]
        if s:
            word.append(s)
            continue
        w = [0, *word, 0]
        for i in range(1, len(w) - 1):
            v += rolled[0][w[i - 1]].astype(int) * rolled[1][w[i]] * rolled[2][w[i + 1]]
        word = []
    return v


def test_bundle_matches_brute_force():
    rng = random.Random(1)
    texts = ["", "a", "Été", "12 x!", "日本 語", *("".join(rng.choice("abcé ö,\n") for _ in range(rng.randint(0, 90))) for _ in range(30))]
    got, letters = langid.bundle(texts)
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in texts]
    for t, v in zip(texts, got):
        assert v == pytest.approx(brute_bundle(t))


def test_many_letters():
    text = "".join(chr(0x4E00 + i) for i in range(3000))
    assert langid.bundle([text])[0][0] == pytest.approx(brute_bundle(text))


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    held = id_remainder(F.col("doc_id"), 4) == 2
    profiles = langid.fit_profiles(docs.filter(~held))
    rows = docs.filter(held).select("lang", langid.predict_language(F.col("text"), profiles).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["p"]["score"] <= 1 for r in rows)


def test_language_awkward_rows(spark):
    profiles = langid.fit_profiles(documents(spark))
    assert profiles.langs == ["en", "fr"]
    rows = documents(spark).select("doc_id", "text", langid.predict_language(F.col("text"), profiles).alias("p")).collect()
    assert all((r["p"]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    assert {r["doc_id"]: r["p"]["lang_pred"] for r in rows}[4] == "fr"
    none = langid.fit_profiles(empty(spark))
    assert documents(spark).select(langid.predict_language(F.col("text"), none)["lang_pred"].alias("l")).filter("l <> 'und'").count() == 0
    assert empty(spark).select(langid.predict_language(F.col("text"), profiles)).count() == 0


def test_language_rule_of_all_rows(spark):
    """Profiles and rule of 6 600 documents are those of all of them, not of a share."""
    rng = random.Random(3)
    words = {"en": ENGLISH.split(), "fr": FRENCH.split()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(60, 75))), k) for i in range(6600) for k in ["en" if i % 2 else "fr"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(docs, max_docs_per_lang=None)
    v, letters = langid.bundle([t for _, t, _ in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    english = np.array([k == "en" for *_, k in rows])
    whole = np.stack([unit[english].sum(0), unit[~english].sum(0)])
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    assert profiles.langs == ["en", "fr"] and profiles.vectors == pytest.approx(whole, abs=1e-5)
    cosine = unit @ profiles.vectors.T
    right = (letters >= langid.LETTERS) & ((cosine[:, 0] > cosine[:, 1]) == english)
    score, margin = cosine.max(1)[right], np.abs(cosine[:, 0] - cosine[:, 1])[right]
    rule = langid.learn_rule(docs, profiles)
    steps = lambda x: np.percentile(np.floor(x * langid.STEPS), 1) / langid.STEPS / 2
    assert rule.score == pytest.approx(max(langid.CHANCE, steps(score)), abs=1e-6) and rule.margin == pytest.approx(steps(margin), abs=1e-6)
