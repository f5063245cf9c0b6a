"""Whole results of the learned operators, row by row, against plain Python that follows their definitions."""

import math
import os
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from crosstally.llm import entries, langid, quality, toxicity
from crosstally.llm.common import id_remainder, table

from .helpers import documents, empty

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# --- quality


def brute_lines(text):
    """Features and length of each line with a printed sign, from the definitions."""
    rows, earlier = [], set()
    for line in (text or "").encode().split(b"\n"):
        words = re.findall(rb"[\x21-\x7e\x80-\xff]+", line)
        printed = b"".join(words)
        if not printed:
            continue
        count = lambda pattern: len(re.findall(pattern, printed))
        p, w = len(printed), len(words)
        signs = count(rb"[\x21-\x7e]") - count(rb"[A-Za-z0-9]") - count(rb"[.,;:!?'\"()\-]")
        rows.append(
            [1, math.log1p(p) / 5, count(rb"[A-Za-z\x80-\xff]") / p, signs / p, (w - len(set(words))) / w, sum(a == b for a, b in zip(words, words[1:])) / w, printed.count(b"|") / w, signs > 0.02 * p]
            + [count(rb"[0-9]") / p, count(rb"[.,;:!?'\"()\-]") / p, count(rb"[A-Z]") / p, min(p / w, 20) / 10, tuple(words) in earlier, bool(re.fullmatch(rb"[.,;:!?'\"()\-]", printed[-1:])), p]
        )
        earlier.add(tuple(words))
    return rows


def brute_score(text, field):
    rows = brute_lines(text)
    if not rows:
        return 0.0, 0
    own = [r[:14] for r in rows]
    none = [0.0] * 7
    near = lambda i: [own[i][k] for k in (1, 2, 3, 4, 6, 7)] + [1.0] if 0 <= i < len(own) else none
    x = np.array([[*own[i], *near(i - 1), *near(i + 1)] for i in range(len(own))], float)
    u, m, n = x @ field.weights, np.exp(field.moves), len(own)
    ahead, back = [np.array([1.0, math.exp(u[0])])], [np.ones(2)]
    for i in range(1, n):
        a = (ahead[-1] @ m) * np.array([1.0, math.exp(u[i])])
        ahead.append(a / a.sum())
    for i in range(n - 1, 0, -1):
        b = m @ (back[-1] * np.array([1.0, math.exp(u[i])]))
        back.append(b / b.sum())
    p = [float((a * b)[1] / (a * b).sum()) for a, b in zip(ahead, back[::-1])]
    mean = sum(q * r[14] for q, r in zip(p, rows)) / sum(r[14] for r in rows)
    return 1 / (1 + math.exp(-(field.slope * math.log(mean / (1 - mean)) + field.shift))), n


def test_quality_of_a_whole_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    field = quality.train_quality(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = entries.op1_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        score, n = brute_score(texts[r["doc_id"]], field)
        assert r["score"] == pytest.approx(score, abs=1e-4) and r["n_lines"] == n and r["predicted"] == (r["score"] >= 0.3)


def test_quality_tells_labels_apart_at_the_threshold(spark):
    rows = entries.op1_quality(spark, "/root/testdata/sf0.1").filter("held_out").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").collect()
    bad, good = [r["predicted"] for r in rows if r["quality"] == 0], [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean(bad) <= 0.1 and np.mean(good) >= 0.95


def test_quality_sample_is_of_whole_documents(spark):
    """The bound on lines leaves documents out, never a part of one."""
    text = "\n".join(f"line {i}, good and long enough." for i in range(50))
    junk = "\n".join("### $$$ %%% ###" for _ in range(50))
    docs = spark.createDataFrame([(i, text if i % 2 else junk) for i in range(20)] + [(99, "x\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(99, 1)], "doc_id long, quality int")
    seen, plain = [], quality.fit_field
    quality.fit_field = lambda x, owner, y, **k: seen.append(Counter(owner.tolist())) or plain(x, owner, y, **k)
    try:
        quality.train_quality(docs, labels, max_lines=520)
        quality.train_quality(docs, labels)
    finally:
        quality.fit_field = plain
    assert set(seen[0].values()) == {50} and len(seen[0]) == 10
    assert sorted(seen[1].values()) == [50] * 20 + [5000]


# --- toxicity


def brute_severity(text, model):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    names = Counter()
    for w in words:
        names[w] += 1
        for n in (3, 5):
            if len(w) > n:
                names["^" + w[:n]] += 1
    score = sum(model.weights[model.place[k]] * math.log1p(n) for k, n in names.items() if k in model.place)
    p = [1 / (1 + math.exp(-(score - t))) for t in model.thresholds]
    each = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
    return sum(p), p[0], each.index(max(each))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_toxicity_of_a_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf, "labels"))
    assert len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = entries.op3_toxicity(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        severity, p, grade = brute_severity(texts[r["doc_id"]], model)
        assert r["severity"] == pytest.approx(severity, abs=1e-9) and r["p_toxic"] == pytest.approx(p, abs=1e-9) and r["grade"] == grade and r["toxic"] == (r["p_toxic"] >= toxicity.THRESHOLD)


def test_toxicity_without_a_telling_word(spark):
    """In a sample too small for any sure word the likeliest ones order the grades."""
    docs = spark.createDataFrame([(i, "vile " * (1 + i % 9) + f"word{i} text" if i < 12 else f"plain word{i} text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    s = {r["doc_id"]: r["t"]["severity"] for r in docs.select("doc_id", toxicity.toxicity_column(F.col("text"), model).alias("t")).collect()}
    assert min(s[i] for i in range(12)) > max(s[i] for i in range(12, 40)) and s[8] > s[0]


# --- language ID


def brute_vector(text):
    slot, rolled = langid._letter_tables()
    v = np.zeros(langid.DIMENSIONS)
    for word in re.split("\0", "".join(c if slot[ord(c)] else "\0" for c in text.lower())):
        s = [0, *(slot[ord(c)] for c in word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            v += (rolled[0][a] * rolled[1][b] * rolled[2][c]).astype(float)
    return v


def test_language_of_a_whole_table(spark):
    """Prototypes from all teaching rows (fewer than the bound), and the choice for every document."""
    rows = table(spark, SF, "documents").select("doc_id", "lang", "text", (id_remainder(F.col("doc_id"), 4) == 2).alias("held")).collect()
    unit = {}
    for r in rows:
        v = brute_vector(r["text"] or "")
        unit[r["doc_id"]] = v / (np.linalg.norm(v) or 1)
    langs = sorted({r["lang"] for r in rows if r["lang"]})
    proto = np.stack([sum(unit[r["doc_id"]] for r in rows if r["lang"] == k and not r["held"]) for k in langs])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    got = {r["doc_id"]: r for r in entries.op6_langid(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        cosine = proto @ unit[r["doc_id"]]
        g = got[r["doc_id"]]
        assert g["held_out"] == r["held"] and g["score"] == pytest.approx(max(0.0, cosine.max()), abs=1e-4)
        if np.diff(np.sort(cosine)[-2:])[0] > 1e-4:
            assert g["lang_pred"] == langs[int(cosine.argmax())]


def test_pieces_of_a_text_are_as_the_whole(monkeypatch):
    texts = ["ab cd", "日本語の長い文" * 9 + " x", "", "Éa1b" * 11]
    whole, letters = langid.bundle(texts)
    monkeypatch.setattr(langid, "CHUNK_CHARS", 7)
    monkeypatch.setattr(langid, "GRAMS", 3)
    parts, again = langid.bundle(texts)
    assert (whole == parts).all() and letters.tolist() == again.tolist() == [4, 64, 0, 33]


_MEASURE = """
import os, random
from crosstally.llm import langid
langid._letter_tables()
mb = lambda: int(open("/proc/self/status").read().split("VmHWM:")[1].split()[0]) / 1024
rng, before = random.Random(1), mb()
v, n = langid.bundle(["".join(map(chr, rng.choices(range(0x4E00, 0x9C00), k=2_000_000)))])
print(round(mb() - before), n[0])
"""


def test_memory_of_a_book_of_many_letters():
    """Two million random CJK letters, nearly all trigrams different: under 600 MB."""
    out = subprocess.run([sys.executable, "-c", _MEASURE], capture_output=True, text=True, timeout=300, cwd=ROOT).stdout.split()
    assert int(out[0]) < 600 and out[1] == "2000000", out


def test_language_stage_rejects(spark):
    """Letterless texts, texts like no learned language and texts surely in another language than stated go; short and unsure ones stay."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    english, french = (docs.filter(f"lang = '{k}' and length(text) > 1500").first()["text"] for k in ("en", "fr"))
    rows = [(-1, english, "en"), (-2, english, "fr"), (-3, french, None), (-4, "ЖЮЩ ъыь " * 100, None), (-5, "12 34", "en"), (-6, None, "en"), (-7, french[:30], "en"), (-8, french, "fr"), (-9, "ЖЮЩ", None)]
    more = docs.unionByName(spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in rows], docs.schema))
    kept = {r["doc_id"] for r in cp.language_id(spark, more, SF).collect()}
    assert {i for i in kept if i < 0} == {-1, -3, -7, -8} | kept & {-9}
    assert len([i for i in kept if i >= 0]) >= 0.995 * docs.count()
    assert cp.language_id(spark, empty(spark), SF).count() == 0 and cp.language_id(spark, documents(spark), SF).columns == documents(spark).columns
