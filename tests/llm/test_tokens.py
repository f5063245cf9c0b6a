import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crosstally.llm import tokens as tk
from crosstally.llm.common import small_side

from .helpers import documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(spark, library):
    rng = random.Random(4)
    parts = ["Hello", "WORLD's", "don't", "x.", "9,", "9", "...,", "é", "É", "́", "İ", "ǅ", "日本語", " ", " ", "\x85", "\x1c", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>a", "a<|endoftext|>b,", "'s", "s'", "‍", "👩‍👩‍👧", "²", "½x", "a.b,c", "-", "I'LL", "가"]
    texts = [rng.choice(["", " ", "\n", "\t", "  "]).join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [p + s for p in parts for s in ("", ".", ",", " ,")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(df, PATH, tk.new_cache(spark)).collect()}
    want = {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_cache_is_appended_and_used(spark, library):
    cache = tk.new_cache(spark)
    df = spark.createDataFrame([(1, "one two"), (2, "one  two"), (3, "three")], "doc_id long, text string")
    tk.count_tokens(df, PATH, cache).collect()
    first = tk.read_cache(spark, cache).collect()
    assert len(first) == 2  # white space doesn't count
    more = df.union(spark.createDataFrame([(4, "four")], "doc_id long, text string"))
    got = {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(more, PATH, cache).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1}
    assert tk.read_cache(spark, cache).count() == 3
    # a stored count is what is used: no text is encoded again
    wrong = tk.new_cache(spark)
    spark.createDataFrame([(r["tokenizer_digest"], r["content_digest"], 77) for r in first], tk.CACHE_SCHEMA).write.parquet(wrong)
    assert {r["n_tokens"] for r in tk.count_tokens(df, PATH, wrong).collect()} == {77}


def test_awkward_rows(spark, library):
    docs = documents(spark)
    rows = tk.count_tokens(docs, PATH, tk.new_cache(spark)).collect()
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    want = sorted((n, i, len(t.encode()), len(library.encode(t, add_special_tokens=False))) for n, i, t in texts)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert {r["doc_id"] for r in rows if r["over_limit"]} == {9}


def test_empty(spark):
    assert tk.count_tokens(empty(spark), PATH, tk.new_cache(spark)).count() == 0


def test_each_missing_digest_is_encoded_once(spark, monkeypatch):
    """Copies, rows of one id with several texts, and copies without an id: the tokenizer's column gets one row a missing digest."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d e"), (None, "d e"), (None, "d  e"), (2, None), (3, "")] * 5 + [(i, "hot text") for i in range(500)], "doc_id long, text string").repartition(7)
    cache, seen, plain = tk.new_cache(spark), [], tk.missing_texts
    monkeypatch.setattr(tk, "missing_texts", lambda *a: seen.append(plain(*a)) or seen[-1])
    for most in (200_000, 0):  # few digests are missing; many are
        monkeypatch.setattr(tk, "small_side", lambda df, most=most: df if most == 0 else small_side(df, most))
        cache = tk.new_cache(spark)
        tk.count_tokens(docs.filter("text = 'c'"), PATH, cache)
        got = tk.count_tokens(docs, PATH, cache).collect()
        sent = [r["content_digest"] for r in seen[-1].collect()]
        assert len(sent) == len(set(sent)) == 4 and tk.read_cache(spark, cache).count() == 5 and len(got) == 540
        again = tk.count_tokens(docs, PATH, cache)
        assert seen[-1].count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, got)) and tk.read_cache(spark, cache).count() == 5


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False), ("piece_bpe_32k.model", False)])
def test_other_tokenizers_get_whole_texts(spark, name, blanks):
    """Only a tokenizer whose file says that it drops white space is given pieces; the others count blanks and case."""
    path = public_tokenizers.path(name)
    assert tk.splits_at_blanks(path) == blanks
    texts = ["Hello  World", "hello world", "\n\n x", "", "a.b, c", "é<|endoftext|> y"]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t)) for t in texts]
    else:
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(docs, path, tk.new_cache(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == want
