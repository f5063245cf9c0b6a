"""The registered queries of this package: each applies one operator, as it would run in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate
from .chat import chat_digests, format_chats
from .common import id_remainder, remove, table
from .decontaminate import contamination, digest_of_items
from .jaccard import near_documents
from .langid import fit_profiles, predict_language
from .licenses import scan_licenses, scan_sql
from .media import media_digests
from .merkle import manifest
from .mixing import mix
from .quality import THRESHOLD, quality_column, train_quality
from .ranking import ranked
from .simhash import near_duplicates
from .tokens import count_tokens, new_cache
from .toxicity import THRESHOLD as TOXIC
from .toxicity import toxicity_column, train_toxicity

TOKENIZER = "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train_quality(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_column(F.col("text"), field).alias("q"))
    return scored.select("doc_id", "held_out", "q.score", (F.col("q.score") >= THRESHOLD).cast("int").alias("predicted"), "q.n_lines", "q.n_bad")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path, cache = table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), new_cache(spark)
    count_tokens(docs, path, cache)  # fills the cache, which is new
    counted = count_tokens(docs, path, cache)  # finds every digest there and encodes nothing
    remove(spark, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels)
    scored = docs.select("doc_id", toxicity_column(F.col("text"), model).alias("t"))
    return scored.select("doc_id", "t.severity", "t.p_toxic", "t.grade", (F.col("t.p_toxic") >= TOXIC).alias("toxic"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit_profiles(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), predict_language(F.col("text"), profiles).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest_of_items(F.col("item_ids")).alias("items_sha256"), "contaminated")


def longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other result of operator 8: where, and how long, each benchmark suffix is found verbatim."""
    return decontaminate.longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_digests(format_chats(rows.unionByName(own)))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(id_remainder(F.col("doc_id"), 7) == 0, F.lit(False))
    told = manifest(table(spark, sf_dir, "documents"), tampered, n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    return told.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_tokens, op3_toxicity, op4_simhash, op5_mixing, op6_langid, op7_licenses, op8_decontaminate, longest_matches, op9_chat, op10_media, op11_ranking, op12_jaccard, op13_merkle, pipeline)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: crc32 of a short ASCII text, bit by bit: a byte is mixed in, then eight shifts follow.
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(generate_series(1, length(CAST(doc_id AS VARCHAR))), lambda i: list_concat([CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)], [CAST(-1 AS BIGINT) FOR k IN generate_series(1, 8)])))),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

ORACLES: dict[str, str] = {
    "op7_licenses": scan_sql(),
    "op8_decontaminate": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
        FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d),
occ AS (SELECT DISTINCT r, i, lens.n, win.item FROM pos, lens, win
        WHERE i + lens.n - 1 <= len(w) AND win.n = lens.n AND win.g = array_to_string(list_slice(w, i, i + lens.n - 1), ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM occ GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "longest_matches": f"""
WITH b AS (SELECT row_number() OVER () AS rb, CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT rb, item, i AS j, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
        FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
occ AS (SELECT rb, item, j, lens.n, r, doc_id, i FROM pos, lens, win
        WHERE i + lens.n - 1 <= len(w) AND win.n = lens.n AND win.g = array_to_string(list_slice(w, i, i + lens.n - 1), ' ')),
chains AS (SELECT *, j - row_number() OVER (PARTITION BY rb, r, i - j ORDER BY j) AS chain FROM occ),
told AS (SELECT item, j, doc_id, i, n + max(j) OVER (PARTITION BY rb, r, i - j, chain) - j AS length FROM chains),
best AS (SELECT *, row_number() OVER (PARTITION BY item, j ORDER BY length DESC, doc_id, i) AS k FROM told)
SELECT item AS item_id, CAST(j - 1 AS BIGINT) AS item_word, CAST(length AS BIGINT) AS length, doc_id, CAST(i - 1 AS BIGINT) AS doc_word FROM best WHERE k = 1""",
    "op11_ranking": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM w WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, doc_id, CAST(n AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score
           FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""",
    "op12_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d),
g AS (SELECT *, min(r) OVER (PARTITION BY s) AS g FROM s),
tok AS (SELECT g, len(s) AS n, unnest(s) AS t FROM g WHERE g = r),
links AS (SELECT a.g AS a, b.g AS b FROM tok a JOIN tok b ON a.t = b.t AND a.g < b.g GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT g, g FROM g WHERE g = r UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
c AS (SELECT reach.a AS g, min(g.doc_id) AS component_id FROM reach JOIN g ON g.g = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id FROM g JOIN c USING (g)""",
    "op13_merkle": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS folded FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
lv(lang, level, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM placed UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subs AS (SELECT lang, level AS tall, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM lv WHERE n = 1),
tops(level, pos, n, h) AS (SELECT 0, k, n, h FROM subs UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
nodes AS (SELECT 0 AS top, lang, level, pos, h FROM lv WHERE n > 1 UNION ALL SELECT 1, NULL, level, pos, h FROM tops WHERE n > 1),
climb(doc_id, leaf, lang, at_pos, top, level, pos, folded, proof, ended) AS (
  SELECT doc_id, leaf, lang, pos, 0, 0, pos, folded, '', false FROM placed UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.at_pos, CASE WHEN s.k IS NULL THEN c.top ELSE 1 END, CASE WHEN s.k IS NULL THEN c.level + 1 ELSE 0 END, CASE WHEN s.k IS NULL THEN c.pos // 2 ELSE s.k END,
    CASE WHEN s.k IS NOT NULL OR c.level = r.level AND c.top = 1 THEN c.folded WHEN c.pos % 2 = 1 THEN sha256(b.h || c.folded) ELSE sha256(c.folded || coalesce(b.h, '')) END,
    c.proof || coalesce(b.h, ''), s.k IS NULL AND c.top = 1 AND c.level = r.level
  FROM climb c CROSS JOIN (SELECT max(level) AS level FROM tops) r
  LEFT JOIN subs s ON c.top = 0 AND s.lang IS NOT DISTINCT FROM c.lang AND s.tall = c.level
  LEFT JOIN nodes b ON s.k IS NULL AND b.top = c.top AND (c.top = 1 OR b.lang IS NOT DISTINCT FROM c.lang) AND b.level = c.level AND b.pos = xor(c.pos, 1)
  WHERE NOT c.ended)
SELECT c.doc_id, c.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.h AS verified
FROM climb c JOIN subs s ON s.lang IS NOT DISTINCT FROM c.lang CROSS JOIN (SELECT h FROM tops WHERE n = 1) t WHERE c.ended""",
}
