"""One registered query per operator, with production parameters over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, capfilters, htmltext, langid, minhash, packing, pieces, quality, spelling, trie, urlfilter, vptree, warc
from .storage import materialise, scan

#: The rules that the URL query judges by, as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Folds: a language is learned where crc32 of the id is not 0 by the modulus, a quality label where it is not 1.
LANGUAGE_FOLDS, QUALITY_FOLDS = 5, 3


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(scan(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def pack_documents(docs: DataFrame, keep_ids: bool) -> DataFrame:
    import public_tokenizers
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                        {"<|endoftext|>": 50256}, keep_ids=keep_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(scan(spark, sf_dir, "documents", ["doc_id", "text"]), keep_ids=False).drop("ids")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", ["doc_id", "text"])
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"), keep=False).drop("ids", "decoded")


def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(scan(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), F.col("vec_id") % 100 == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(scan(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(scan(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(scan(spark, sf_dir, "pages", ["page_id", "url"]),
                                urlfilter.rules_table(spark, URL_RULES))


def learn_languages(spark: SparkSession, sf_dir: str) -> langid.LanguageModel:
    return langid.learn_languages(scan(spark, sf_dir, "documents", ["doc_id", "text", "lang"]),
                                  langid.fold(LANGUAGE_FOLDS) != 0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", ["doc_id", "text"])
    held_out = F.coalesce(langid.fold(LANGUAGE_FOLDS) == 0, F.lit(True))
    return (langid.predict_languages(docs, learn_languages(spark, sf_dir))
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


def learn_quality(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    return quality.learn_quality(scan(spark, sf_dir, "documents", ["doc_id", "text"]),
                                 scan(spark, sf_dir, "labels", ["doc_id", "quality"]),
                                 langid.fold(QUALITY_FOLDS) != 1)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", ["doc_id", "text"])
    held_out = F.coalesce(langid.fold(QUALITY_FOLDS) == 1, F.lit(True))
    return (quality.score_quality(docs, learn_quality(spark, sf_dir))
            .select("doc_id", held_out.alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op10_capfilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_vectors(scan(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents", ["doc_id", "text"])
    return pieces.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), keep=False).drop("ids", "decoded")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % 5 in place of its own first h, where
    h = crc32(c) % 9."""
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    begins = turns.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("begin"))
    own = turns.select("conv_id", "turns", base.alias("base"), head.cast("int").alias("head"))
    return own.join(begins, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("begin", F.array().cast("array<string>")), F.lit(1), F.col("head")),
        F.slice("turns", F.col("head") + 1, F.size("turns"))).alias("turns"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.conversation_turns(scan(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    return trie.prefix_trie(rebuilt(materialise(turns, "turns")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(scan(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extract, op2_packing, op3_bpe, op4_vptree, op5_warc, op6_minhash, op7_urlfilter,
                            op8_langid, op9_quality, op10_capfilters, op11_sentencepiece, op12_conversation_trie,
                            op13_spelling_variants)}

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

def _crc32(codes: str) -> str:
    """The unsigned CRC-32 of a list of byte values, in DuckDB."""
    return f"""xor(4294967295, list_reduce([4294967295] || {codes}, lambda s, b: list_reduce(
      [xor(s, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda t, i: xor(t >> 1, (t & 1) * 3988292384))))"""


SQL: dict[str, str] = {
    "op5_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)
         AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM g""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
    FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS lo FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.lo, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(c.lo, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id""",
    "op7_urlfilter": rf"""
WITH rules(rhost, rpath, verdict) AS (VALUES {_RULES}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS row FROM pages),
f AS (
  SELECT u.*, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY row ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS nth
  FROM u LEFT JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE nth = 1""",
    "op10_capfilters": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings),
o AS (SELECT vec_id, d FROM v
  WHERE d IS NOT NULL AND list_bool_and(list_transform(d, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(d, lambda x: x <> 0))),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM o a JOIN o b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.d, b.d) >= 0.9),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS lo FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, least(v.vec_id, coalesce(c.lo, v.vec_id)) AS component_id,
  least(v.vec_id, coalesce(c.lo, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN c ON c.x = v.vec_id LEFT JOIN k ON k.x = v.vec_id""",
    "op12_conversation_trie": rf"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts,
    {_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, c.h), list_slice(c.ts, c.h + 1, len(c.ts))) AS ts
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS d, ts FROM r),
m AS (
  SELECT list_slice(ts, 1, d) AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY ALL),
k AS (SELECT list_slice(path, 1, d - 1) AS path, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY ALL),
o AS (
  SELECT m.*, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN m.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(m.path[m.d].t) END AS saving
  FROM m LEFT JOIN k ON k.path = m.path AND k.d = m.d),
a AS (SELECT path, unnest(range(0, d + 1)) AS above, n_children, saving FROM o),
s AS (
  SELECT list_slice(path, 1, above) AS path, above AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum(saving) AS saved_tokens
  FROM a GROUP BY ALL)
SELECT o.conv_id, o.d AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN s ON s.path = o.path AND s.d = o.d
LEFT JOIN m q ON o.d > 0 AND q.d = o.d - 1 AND q.path = list_slice(o.path, 1, o.d - 1)""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
d AS (SELECT doc, run, count(*) AS k FROM t WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, k, {_crc32("""flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE
    WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)]
    ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))""")} AS h FROM d),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
    ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
c AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x),
e AS (
  SELECT a.word AS x, b.word AS y FROM c a JOIN c b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word FROM c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM c JOIN v ON v.word = c.rest),
g AS (
  SELECT x, y, n, count(*) OVER (PARTITION BY x) AS n_near,
    row_number() OVER (PARTITION BY x ORDER BY n DESC, encode(y)) AS nth FROM e JOIN v ON v.word = e.y),
f AS (
  SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.n >= 10 * v.n THEN g.y END AS form,
    CASE WHEN g.n >= 10 * v.n THEN g.n END AS form_n
  FROM v LEFT JOIN g ON g.x = v.word AND g.nth = 1),
r(word, root) AS (
  SELECT word, word FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word""",
}
