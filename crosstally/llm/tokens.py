"""Token counts with a digest cache.

The cache is a table of (tokenizer_digest, content_digest, n_tokens). Texts are normalised in a way that can't change their count,
digested, and joined to the cache; of the digests without an entry one document each is read again and encoded, and their counts are
appended. Only then are all documents joined to the cache. A digest is one row however many documents share it.

Some tokenizers, word_bpe_49k among them, drop white space between words, which their files tell: for these runs of ASCII white space count
as one blank; upper and lower case stay apart, because the special strings are recognised in the text as it is written. Their words
can't cross white space either: inside a task a text is counted piece by piece, and pieces met before are looked up in a bounded memo.
All other tokenizers get whole texts, unchanged.

Defined cases: null text is empty and has 0 tokens; empty input gives no rows; repeated rows, and rows without an id, get the same count
each and are encoded once; texts are never cut, whatever their length; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_side

LIMIT = 2048
CACHE_SCHEMA = "tokenizer_digest string, content_digest string, n_tokens long"
#: Pieces that a worker remembers.
MEMO = 300_000

_memos: dict[str, tuple] = {}


def tokenizer_digest(path: str) -> str:
    """Identifies a tokenizer by its file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\n" + f.read()).hexdigest()


# The pre-tokenizer pattern, and the normalisers, of which it is known that no token crosses white space, that a run of it
# counts as one blank, and that a dot or comma after an ASCII letter or digit is a word of its own.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ("NFC", "Lowercase", "Replace")


def splits_at_blanks(path: str) -> bool:
    """Whether a tokenizers file, by its own normaliser and pre-tokenizer, drops white space between words and lower-cases.

    Only then may runs of white space be made one and pieces be counted apart; any other tokenizer gets whole texts as they are.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    normal, pre = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps, cuts = normal.get("normalizers", [normal]), pre.get("pretokenizers", [pre])
    first = cuts[0] if cuts else {}
    known = [x.get("type") for x in steps]
    blanks = [x for x in steps if x.get("type") == "Replace"]
    return (
        set(known) <= set(_NORMALIZERS)
        and "Lowercase" in known
        and all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in blanks)
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": _WORD_PATTERN}
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in cuts[1:])
        and not any(any(c.isspace() for c in x["content"]) or x.get("lstrip") or x.get("rstrip") or not x["content"].startswith("<|") for x in told.get("added_tokens", []))
    )


def normalised(text: Column, blanks: bool = True) -> Column:
    """The text whose digest is stored: null is empty; runs of ASCII white space are one blank where these don't count."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_replace(t, r"[\x09-\x0D\x20]+", " ") if blanks else t


class _Whole:
    """Counts of whole texts, by the library of the file's kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda t: len(model.encode(t))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda t: len(tokenizer.encode(t, add_special_tokens=False))

    def counts(self, texts: list[bytes]) -> list[int]:
        return [self.count(t.decode("utf-8", "replace")) for t in texts]


class _Counter:
    """Counts of white-space separated pieces, by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def learn(self, pieces: set[bytes]) -> None:
        """A piece that ends in . or , after an ASCII letter or digit has the tokens of what stands before, and one; see the library's pattern."""
        memo = self.memo
        marked = [p for p in pieces if p[-1] in b".," and p[-2:-1].isalnum()]
        stems = list({*pieces.difference(marked), *(p[:-1] for p in marked)} - memo.keys())
        for i in range(0, len(stems), 4096):
            part = stems[i : i + 4096]
            told = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in part], add_special_tokens=False)
            memo.update(zip(part, map(len, told)))
        marks = {c: len(self.tokenizer.encode(chr(c), add_special_tokens=False)) for c in b".,"}
        for p in marked:
            memo[p] = memo[p[:-1]] + marks[p[-1]]

    def counts(self, texts: list[bytes]) -> list[int]:
        # the library composes characters before it lower-cases: only pieces that are wholly ASCII may be lower-cased before
        split = [t.split() if b"<|" in t else t.lower().split() if t.isascii() else [p.lower() if p.isascii() else p for p in t.split()] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        if fresh := set(chain.from_iterable(split)) - self.memo.keys():
            self.learn(fresh)
        of = self.memo.__getitem__
        return [sum(map(of, s)) for s in split]


def count_column(text: Column, path: str) -> Column:
    """n_tokens of whole texts by a tokenizers (.json) or sentencepiece (.model) file, without added special tokens, truncation or padding."""
    version, make = tokenizer_digest(path), _Counter if splits_at_blanks(path) else _Whole

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if version not in _memos:
            _memos[version] = make(path)
        counter = _memos[version]
        for b in batches:
            texts, out, start, size = [(t or "").encode("utf-8", "replace") for t in b], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 2_000_000 or i == len(texts) - 1:
                    out += counter.counts(texts[start : i + 1])
                    start, size = i + 1, 0
            yield pd.Series(out, dtype="int64")

    return counted(text)


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return spark.createDataFrame([], CACHE_SCHEMA)


def missing_texts(docs: DataFrame, missing: DataFrame, digest: Column) -> DataFrame:
    """content_digest, text: one row for each digest of missing(content_digest), which is stored, with a text of docs(text) that has it.

    Where few digests are missing, only their texts are taken from the scan. Otherwise texts move once, and copies are merged where they
    are read, so a digest with very many copies sends one text a task.
    """
    few, rows = small_side(missing), docs.select(digest.alias("content_digest"), "text")
    one = lambda df: df.groupBy("content_digest").agg(F.any_value("text").alias("text"))
    return one(rows).join(missing, "content_digest", "left_semi") if few is missing else one(rows.join(few, "content_digest", "left_semi"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, content_digest for every row of docs(doc_id, text); the folder ``cache`` gains what it lacked.

    Digests are all that is compared with the cache; the text of each digest that it lacks is encoded once, however many rows have it.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    docs = docs.select("doc_id", "text")
    digest = F.sha2(normalised(F.col("text"), splits_at_blanks(tokenizer_path)), 256)
    digests = cut(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("content_digest")))
    known = read_cache(spark, cache).filter(F.col("tokenizer_digest") == version).select("content_digest")
    missing = cut(digests.select("content_digest").distinct().join(known, "content_digest", "left_anti"))
    fresh = missing_texts(docs, missing, digest).select("content_digest", count_column(F.col("text"), tokenizer_path).alias("n_tokens"))
    fresh.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(cache)
    # stored apart, so that the join below reads two plain sides and a digest with very many documents can be split
    stored = cut(read_cache(spark, cache).filter(F.col("tokenizer_digest") == version).dropDuplicates(["content_digest"]).select("content_digest", "n_tokens"))
    counted = digests.join(stored, "content_digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest")


def new_cache(spark: SparkSession) -> str:
    """A cache folder that no other run uses."""
    return f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
