import public_tokenizers
from tokenizers import Tokenizer

from crosstally.llm import tokens as tk

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_capitals_that_compose_only_in_lower_case(spark):
    """Decomposed capitals are counted as the library counts them: it composes first and lower-cases then."""
    library = Tokenizer.from_file(PATH)
    pieces = [a + c + m + b for c, m in (("J", "\u030c"), ("H", "\u0331"), ("T", "\u0308"), ("W", "\u030a"), ("Y", "\u030a"), ("E", "\u0301")) for a in ("", "a") for b in ("", "b", ".", ",")]
    texts = pieces + [f"Some TEXT {p} HERE" for p in pieces] + [f"<|endoftext|> {p}" for p in pieces]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(df, PATH, tk.new_cache(spark)).collect()}
    want = {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
