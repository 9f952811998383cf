"""The registered queries: each operator applied to whole tables, with SQL that says the same where SQL can.

QUERIES: name -> function of (spark, sf_dir). ORACLE: name -> DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answer_cache, chunking, context, dense, evaluation, fusion, hybrid, registry, rendering, sparse, usage
from lodestone.plans.config import EngineConfig
from lodestone.plans.service import Engine
from lodestone.sources import elements, layout
from lodestone.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CONFIG = EngineConfig()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL fragments

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN ({_STOP}))"


def _tokens(x: str) -> str:
    return f"CAST(ceil(length({x}) / 4.0) AS BIGINT)"


def _keyterms(x: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '{T.TERM}'), lambda t: regexp_matches(t, '[0-9]'))))"


def _quotable(x: str) -> str:
    straight = "'''''\"\"'"
    return rf"lower(trim(regexp_replace(regexp_replace(translate({x}, '‘’“”', {straight}), '[|*_`#>]', ' ', 'g'), '\s+', ' ', 'g')))"


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{200b}}\x{{feff}}]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


def _clean(x: str) -> str:
    return _CLEAN.format(x=x)


def _bm25(filter_sql: str = "", k: int = CONFIG.bm25_k, queries: str = "SELECT item_id AS query_id, text FROM benchmark", docs: str = "SELECT doc_id AS chunk_id, text, lang FROM documents") -> str:
    return f"""
    docs AS ({docs}), asked_text AS ({queries}),
    tok AS (SELECT chunk_id, lang, unnest({_terms("text")}) AS token FROM docs), tf AS (SELECT chunk_id, lang, token, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT chunk_id, len({_terms("text")}) AS dl FROM docs), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
    asked AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_terms("text")}) AS token FROM asked_text) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    hit AS (SELECT query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 9) AS score
        FROM asked JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (chunk_id), st {filter_sql} GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hit WHERE score > 0) WHERE rank <= {k})"""


def _dense(k: int = CONFIG.dense_k, where: str = "true", every: int = 100) -> str:
    return f"""
    dq AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % {every} = 0),
    ds AS (SELECT query_id, vec_id AS chunk_id, round(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)) / (sqrt(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))) * sqrt(list_inner_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)))), 6) AS s6,
        round(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)) / (sqrt(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))) * sqrt(list_inner_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)))), 9) AS score FROM dq q, embeddings e WHERE {where}),
    de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds) WHERE rank <= {k})"""


# -- identities and text


@query("SELECT doc_id, sha256('docs/' || source || '/' || doc_id || '.txt')[1:16] AS doc_hash, sha256(text) AS content_hash, sha256('m|64|' || source || '|' || text)[1:16] AS embed_hash FROM documents")
def doc_ids_and_hashes(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    key = F.concat(F.lit("docs\\"), "source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".txt "))
    return d.select("doc_id", T.document_id(key).alias("doc_hash"), F.sha2("text", 256).alias("content_hash"), T.embedding_key("m", 64, "source", "text").alias("embed_hash"))


@query("SELECT doc_id, doc_id || '-p' || lpad(CAST(n_chars % 7 AS VARCHAR), 4, '0') AS parent_id, doc_id || '-c' || lpad(CAST(n_chars % 999 AS VARCHAR), 5, '0') AS chunk_id FROM documents")
def parent_chunk_ids(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", T.parent_id("doc_id", F.col("n_chars") % 7).alias("parent_id"), T.chunk_id("doc_id", F.col("n_chars") % 999).alias("chunk_id"))


@query(f"SELECT doc_id, {_tokens('text')} AS tokens, substr(text, 1, 64) AS first16, {_tokens('text[1:64]')} AS tokens16, CAST(ceil(length(text) / 400.0) AS BIGINT) AS windows FROM documents")
def token_estimates(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("first16", T.first_tokens("text", 16))
    return d.select("doc_id", T.token_count("text").alias("tokens"), "first16", T.token_count("first16").alias("tokens16"), F.size(T.token_windows("text", 100)).cast("long").alias("windows"))


@query("SELECT doc_id, CAST(i AS INT) AS i, substr(text, i * 400 + 1, 400) AS piece FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 400.0) AS BIGINT))) AS i FROM documents)")
def token_windows(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.token_windows("text", 100)).alias("i", "piece"))


@query(f"SELECT doc_id, md5({_clean('text')}) AS cleaned FROM (SELECT doc_id, chr(7) || ' ' || replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(9)) AS text FROM documents)")
def clean_text(spark, sf_dir):
    messy = F.concat(F.lit("\x07 "), F.regexp_replace("text", "\n", "  \r\n\n\n\t"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(messy)).alias("cleaned"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, md5(array_to_string(t, ' ')) AS terms FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)")
def tokenize_terms(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", T.terms("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.concat_ws(" ", "t")).alias("terms"))


@query(f"SELECT token, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM documents) WHERE token IN ({_STOP}) GROUP BY token")
def stopword_filter(spark, sf_dir):
    found = F.explode(F.regexp_extract_all(T.fold("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    t = load(spark, sf_dir, "documents").select(found.alias("token"))
    return t.where(F.col("token").isin(T.STOPWORDS)).groupBy("token").agg(F.count("*").alias("uses"))


@query(f"SELECT doc_id, array_to_string({_keyterms('text')}, ' ') AS terms FROM documents")
def key_terms(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", T.key_terms("text")).alias("terms"))


@query(f"SELECT item_id, {_quotable('text')} AS quote FROM (SELECT item_id, '“' || text || '” | *b* `c`' AS text FROM benchmark)")
def quote_normalize(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.quotable(F.concat(F.lit("“"), "text", F.lit("” | *b* `c`"))).alias("quote"))


_GAPS = r"""list_filter(string_split(regexp_replace(text, '([.!?])\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"""


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS sentences FROM (SELECT doc_id, {_GAPS} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.concat_ws("|", "s")).alias("sentences"))


_TAIL = f"""WITH s AS (SELECT doc_id, {_GAPS.replace('text', "replace(text, chr(10), ' ')")} AS s, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
    cut AS (SELECT doc_id, s[greatest(1, len(s) - 40):] AS s, w[greatest(1, len(w) - 160):] AS w FROM s),
    n AS (SELECT *, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda m: list_sum(list_transform(s[len(s) - m + 1:], lambda x: ceil(length(x) / 4.0))) <= {CONFIG.child_overlap})), 0) AS a,
        coalesce(list_max(list_filter(range(1, len(w) + 1), lambda m: ceil(length(array_to_string(w[len(w) - m + 1:], ' ')) / 4.0) <= {CONFIG.child_overlap})), 0) AS b FROM cut)
    SELECT doc_id, CASE WHEN a > 0 THEN array_to_string(s[len(s) - a + 1:], ' ') WHEN b > 0 THEN array_to_string(w[len(w) - b + 1:], ' ') ELSE '' END AS tail FROM n"""


@query(_TAIL)
def sentence_tail_overlap(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.sentence_tail("text", CONFIG.child_overlap).alias("tail"))


# -- sources


@query(
    rf"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS at, CASE WHEN level IS NOT NULL THEN 'heading' WHEN listed THEN 'list' ELSE 'paragraph' END AS kind, CAST(level AS INT) AS level, md5(CASE WHEN level IS NULL AND NOT listed THEN replace(b, chr(10), ' ') ELSE b END) AS text
    FROM (SELECT *, CASE WHEN contains(b, chr(10)) OR length(b) > 80 OR regexp_matches(b, '[.,;?!]$') THEN NULL WHEN regexp_matches(b, '{elements.NUMBERED}') THEN length(regexp_replace(regexp_extract(b, '{elements.NUMBERED}', 1), '[^.]', '', 'g')) + 1
            WHEN length(regexp_replace(b, '\P{{L}}+', '', 'g')) >= 3 AND NOT regexp_matches(regexp_replace(b, '\P{{L}}+', '', 'g'), '[^\p{{Lu}}]') THEN 1 END AS level,
        len(list_filter(string_split(b, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:[-*+•▪◦‣]|\d{{1,3}}[.)])\s+'))) = 0 AS listed
        FROM (SELECT doc_id, unnest(range(len(bs))) AS i, trim(unnest(bs)) AS b FROM (SELECT doc_id, string_split_regex({_clean("text")}, '\n\s*\n') AS bs FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents))) WHERE b <> '')"""
)
def plain_text_blocks(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(elements.plain_elements(F.regexp_replace("text", "\n", "\n\n"))).alias("at", "e"))
    return d.select("doc_id", "at", "e.kind", "e.level", F.md5("e.text").alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, split_part(replace(trim(url), chr(92), '/'), '#', 1) AS source_key, substr(regexp_replace(regexp_replace(url, '^[a-z]+://([^/?#]*)([^?#]*).*$', '\\1\\2'), '/+$', ''), 1, 120) AS name FROM pages")
def page_names(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), T.source_key("url").alias("source_key"), elements.display_name("url").alias("name"))


@query(
    r"""WITH b AS (SELECT page_id, string_split_regex(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<h1>', '<p>' || chr(2)), '</?(?:p|h1)>') AS parts FROM pages),
    e AS (SELECT page_id, unnest(parts) AS t, unnest(range(len(parts))) AS i FROM b),
    u AS (SELECT page_id, i, starts_with(t, chr(2)) AS h, replace(replace(replace(replace(replace(replace(regexp_replace(ltrim(t, chr(2)), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&') AS t FROM e),
    x AS (SELECT page_id, i, h, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM u)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS at, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN h THEN 1 END AS level, text FROM x WHERE text <> ''"""
)
def page_elements(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", elements.page_elements("html").alias("p"))
    return p.select("page_id", F.posexplode("p.elements").alias("at", "e")).select("page_id", "at", "e.kind", "e.level", "e.text")


_ATX = r"^\s*(#{1,6})\s+(.+?)\s*#*\s*$"


@query(
    rf"""WITH l AS (SELECT doc_id, source, unnest(ls) AS t, unnest(range(len(ls))) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
    e AS (SELECT doc_id, source, -1 AS i, 0 AS j, 'heading' AS kind, 1 AS level, source AS text FROM documents UNION ALL SELECT doc_id, source, i, 0, 'list', NULL, '- item' FROM l WHERE i > 0
        UNION ALL SELECT doc_id, source, i, 1, CASE WHEN trim(t) = '' THEN 'paragraph' ELSE 'heading' END, CASE WHEN trim(t) <> '' THEN 2 END, CASE WHEN trim(t) = '' THEN '##' ELSE {_clean(f"regexp_extract('## ' || t, '{_ATX}', 2)")} END FROM l WHERE i > 0
        UNION ALL SELECT doc_id, source, i, 1, CASE WHEN regexp_matches(t, '{_ATX}') THEN 'heading' WHEN regexp_matches(t, '^\s*(?:[-*+•▪◦‣]|\d{{1,3}}[.)])\s+') THEN 'list' ELSE 'paragraph' END, CASE WHEN regexp_matches(t, '{_ATX}') THEN length(regexp_extract(t, '{_ATX}', 1)) END,
            CASE WHEN regexp_matches(t, '{_ATX}') THEN {_clean(f"regexp_extract(t, '{_ATX}', 2)")} WHEN regexp_matches(t, '^\s*(?:[-*+•▪◦‣]|\d{{1,3}}[.)])\s+') THEN rtrim(t) ELSE {_clean("ltrim(trim(t), '> ')")} END FROM l WHERE i = 0 AND trim(t) <> '')
    SELECT doc_id, source AS title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INT) AS at, kind, CAST(level AS INT) AS level, md5(text) AS text FROM e"""
)
def markdown_elements(spark, sf_dir):
    md = F.concat(F.lit("---\ntitle: '"), "source", F.lit("'\n---\n# "), "source", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n- item\n\n## "))
    d = load(spark, sf_dir, "documents").select("doc_id", elements.markdown_elements(md).alias("p"))
    return d.select("doc_id", F.col("p.title").alias("title"), F.posexplode("p.elements").alias("at", "e")).select("doc_id", "title", "at", "e.kind", "e.level", F.md5("e.text").alias("text"))


def _lines(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    place = F.col("n") % 8
    return d.select("doc_id", F.floor(F.col("n") / 8).cast("int").alias("page"), "n", F.when(place == 0, F.concat(F.lit("Report 20"), F.col("n").cast("string"))).otherwise(F.col("text")).alias("text"), (F.lit(9.0) + F.length("text") % 3).alias("size"), (place / 8.0).alias("rel_top"))


_LINES = "lines AS (SELECT doc_id, CAST(n // 8 AS INT) AS page, CAST(n AS INT) AS n, CASE WHEN n % 8 = 0 THEN 'Report 20' || n ELSE t END AS text, 9.0::DOUBLE + length(t) % 3 AS size, (n % 8) / 8.0::DOUBLE AS rel_top FROM (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


@query(
    rf"""WITH {_LINES}, k AS (SELECT *, rel_top < 0.1 OR rel_top > 0.9 AS margin, trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM lines),
    kept AS (SELECT * FROM k WHERE NOT regexp_matches(trim(text), '^\d{{1,4}}$') AND NOT (margin AND regexp_matches(lower(text), '\bpage\s+\d+'))),
    pages AS (SELECT doc_id, count(DISTINCT page) AS p FROM lines GROUP BY 1), often AS (SELECT doc_id, key FROM kept JOIN pages USING (doc_id) WHERE margin GROUP BY doc_id, key, p HAVING count(DISTINCT page) >= greatest(2, ceil(p / 2.0)))
    SELECT doc_id, page, n, md5(text) AS text FROM kept WHERE NOT (margin AND (doc_id, key) IN (SELECT doc_id, key FROM often))"""
)
def page_furniture(spark, sf_dir):
    return layout.without_furniture(_lines(spark, sf_dir)).select("doc_id", "page", "n", F.md5("text").alias("text"))


@query(f"WITH {_LINES} SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(text)) DESC, min(n)) AS r FROM lines GROUP BY doc_id, size) WHERE r = 1")
def body_font_mode(spark, sf_dir):
    return layout.body_size(_lines(spark, sf_dir))


# -- chunks


def _documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), elements.plain_elements("text").alias("elements"))


@query()
def child_chunks(spark, sf_dir):
    return chunking.chunk_documents(_documents(spark, sf_dir), CONFIG).select("doc_id", "chunk_id", "chunk_index", "parent_id", "section_path", "token_count", "content_hash")


@query()
def parent_sections(spark, sf_dir):
    return chunking.parents_of(chunking.chunk_rows(_documents(spark, sf_dir), CONFIG)).select("parent_id", "doc_id", "position", "section_path", "token_count")


@query(
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, h AS content_hash FROM (SELECT doc_id, min(i) AS i, h FROM (SELECT doc_id, i, sha256(t)[1:16] AS h FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) GROUP BY doc_id, h)"
)
def chunk_dedup(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.posexplode(F.split("text", "\n", -1)).alias("_at", "text"), F.lit(0).alias("parent"), F.lit("").alias("path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    return chunking.chunks_of(d.withColumn("content_hash", T.short_hash("text"))).select("doc_id", "chunk_index", "content_hash")


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_docs(spark, sf_dir):
    d = load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return d.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# -- keyword search


def _questions(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({_terms('text')})) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT token, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM t, n GROUP BY token")
def doc_frequency(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    df = sparse.document_frequency(d, "text").join(F.broadcast(d.agg(F.count("*").alias("n"))))
    return df.select("token", "df", F.round(sparse.idf(F.col("df"), F.col("n")), 9).alias("idf"))


@query(f"SELECT count(*) AS n_chunks, round(sum(len({_terms('text')})) / count(*), 9) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return sparse.corpus_stats(load(spark, sf_dir, "documents"), "text").withColumn("avgdl", F.round("avgdl", 9))


@query(f"WITH {_bm25()} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    out = sparse.bm25_topk(_questions(spark, sf_dir), load(spark, sf_dir, "documents"), CONFIG.bm25_k, "doc_id")
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25(chr(32) + 'WHERE lang IN (' + chr(39) + 'de' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + ')')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm")
def bm25_filtered_topk(spark, sf_dir):
    out = sparse.bm25_topk(_questions(spark, sf_dir), load(spark, sf_dir, "documents"), CONFIG.bm25_k, "doc_id", keep=F.col("lang").isin("de", "fr"))
    return out.withColumn("score", F.round("score", 6))


# -- vector search and fusion


def _vector_queries(spark, sf_dir, every=100):
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _dense_list(spark, sf_dir, k=CONFIG.dense_k, keep=None):
    return dense.dense_topk(_vector_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"), k, "vec_id", keep=keep)


@query(f"WITH {_dense()} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM de")
def dense_topk(spark, sf_dir):
    return _dense_list(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_dense(where='e.label IN (1, 3, 5)')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM de")
def dense_filtered_topk(spark, sf_dir):
    return _dense_list(spark, sf_dir, keep=F.col("label").isin(1, 3, 5)).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(sqrt(list_inner_product(list_transform(embedding, lambda x: 3 * x::DOUBLE), list_transform(embedding, lambda x: 3 * x::DOUBLE))), 6) AS before, CAST(1 AS DOUBLE) AS after FROM embeddings")
def l2_normalize(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 3 * x.cast("double")).alias("v"))
    return v.select("vec_id", F.round(dense.l2_norm("v"), 6).alias("before"), F.round(dense.l2_norm(dense.l2_normalize(F.col("v"))), 6).alias("after"))


def _rankings(spark, sf_dir):
    """Two dense lists of each query: all vectors, and those of its own label's parity."""
    a = _dense_list(spark, sf_dir).withColumn("list_no", F.lit(0)).withColumn("retriever", F.lit("dense")).withColumn("query_text", F.lit("original"))
    b = _dense_list(spark, sf_dir, keep=F.col("label") % 2 == 0).withColumn("list_no", F.lit(1)).withColumn("retriever", F.lit("dense")).withColumn("query_text", F.lit("variant"))
    c = _dense_list(spark, sf_dir, 10, keep=F.col("label") > 4).withColumn("list_no", F.lit(2)).withColumn("retriever", F.lit("bm25")).withColumn("query_text", F.lit("original"))
    return a.unionByName(b).unionByName(c)


_RANKINGS = f"""{_dense()}, d2 AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds s JOIN embeddings e ON e.vec_id = s.chunk_id WHERE e.label % 2 = 0) WHERE rank <= {CONFIG.dense_k}),
    d3 AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds s JOIN embeddings e ON e.vec_id = s.chunk_id WHERE e.label > 4) WHERE rank <= 10),
    ranked AS (SELECT query_id, chunk_id, score, rank, 0 AS list_no, 'dense' AS retriever, 'original' AS query_text FROM de UNION ALL SELECT query_id, chunk_id, score, rank, 1, 'dense', 'variant' FROM d2 UNION ALL SELECT query_id, chunk_id, score, rank, 2, 'bm25', 'original' FROM d3),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best_rank, first_seen) AS place FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(rank) AS best_rank, min(list_no * 1000000 + rank) AS first_seen FROM ranked GROUP BY ALL))"""


@query(f"WITH {_RANKINGS} SELECT query_id, chunk_id, rrf_score, CAST(best_rank AS BIGINT) AS best_rank, CAST(first_seen AS BIGINT) AS first_seen, CAST(place AS BIGINT) AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(_rankings(spark, sf_dir), CONFIG.rrf_k)


@query(
    f"WITH {_RANKINGS}, w AS (SELECT query_id, chunk_id, round(sum((CASE WHEN retriever = 'bm25' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) / (60 + rank)), 9) AS s, min(rank) AS b, min(list_no * 1000000 + rank) AS f FROM ranked GROUP BY ALL) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, b, f) AS BIGINT) AS rank FROM w"
)
def rrf_weighted(spark, sf_dir):
    r = _rankings(spark, sf_dir).withColumn("w", F.when(F.col("retriever") == "bm25", 2.0).otherwise(1.0))
    return fusion.rrf(r, CONFIG.rrf_k, weight_col="w").select("query_id", "chunk_id", "rank")


@query(f"WITH {_RANKINGS} SELECT query_id, chunk_id, CAST(min(rank) FILTER (WHERE retriever = 'dense') AS BIGINT) AS dense_rank, round(arg_min(score, rank * 10 + list_no) FILTER (WHERE retriever = 'dense'), 6) AS dense_score, CAST(min(rank) FILTER (WHERE retriever = 'bm25') AS BIGINT) AS bm25_rank, round(min(score) FILTER (WHERE retriever = 'bm25'), 6) AS bm25_score FROM ranked GROUP BY ALL")
def stage_scores(spark, sf_dir):
    s = fusion.stage_scores(_rankings(spark, sf_dir))
    return s.withColumn("dense_score", F.round("dense_score", 6)).withColumn("bm25_score", F.round("bm25_score", 6))


@query(f"WITH {_RANKINGS} SELECT query_id, chunk_id, string_agg(query_text, ',' ORDER BY f) AS matched FROM (SELECT query_id, chunk_id, query_text, min(list_no) AS f FROM ranked GROUP BY ALL) GROUP BY ALL")
def matched_queries(spark, sf_dir):
    return fusion.matched_queries(_rankings(spark, sf_dir)).withColumn("matched", F.concat_ws(",", "matched"))


def _hybrid(spark, sf_dir):
    """Questions against documents: each question's vector and text, and a hypothetical answer's vector, fused.

    The vectors of documents, questions (item) and hypothetical answers (item + 40) are those of the same number.
    """
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = _questions(spark, sf_dir).withColumnRenamed("query_id", "request_id")
    asked = q.select("*", F.col("request_id").alias("v"), F.lit(0).alias("pos"), F.lit("original").alias("kind")).unionByName(q.select("*", (F.col("request_id") + 40).alias("v"), F.lit(1).alias("pos"), F.lit("hyde").alias("kind")))
    asked = asked.join(e.withColumnRenamed("chunk_id", "v"), "v").drop("v")
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    lists = hybrid.rankings(asked, e, texts, CONFIG.dense_k, CONFIG.bm25_k)
    return fusion.rrf(lists.withColumnRenamed("request_id", "query_id"), CONFIG.rrf_k)


_HYBRID = f"""{_bm25()}, hq AS (SELECT item_id AS query_id, 0 AS l, embedding FROM benchmark JOIN embeddings ON vec_id = item_id UNION ALL SELECT item_id, 1, embedding FROM benchmark JOIN embeddings ON vec_id = item_id + 40),
    hs AS (SELECT query_id, l, vec_id AS chunk_id, round(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)) / (sqrt(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))) * sqrt(list_inner_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)))), 9) AS score FROM hq q, embeddings e),
    lists AS (SELECT query_id, chunk_id, rank, l FROM (SELECT *, row_number() OVER (PARTITION BY query_id, l ORDER BY score DESC, chunk_id) AS rank FROM hs) WHERE rank <= {CONFIG.dense_k} UNION ALL SELECT query_id, chunk_id, rank, 1000 FROM bm JOIN hq USING (query_id) WHERE l = 0),
    hyb AS (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, b, f) AS position FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, min(rank) AS b, min(l * 1000000 + rank) AS f FROM lists GROUP BY ALL))"""


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, rrf_score, CAST(position AS BIGINT) AS rank FROM hyb")
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "chunk_id", "rrf_score", "rank")


def _scored(spark, sf_dir):
    """Candidates with a score from a hash, as a model's would come."""
    score = (F.conv(F.substring(F.md5(F.concat_ws("-", "query_id", "chunk_id")), 1, 6), 16, 10).cast("long") % 1000) / 1000.0
    return _hybrid(spark, sf_dir).select("query_id", "chunk_id", F.col("rank").alias("position"), "rrf_score", score.alias("rerank_score"))


_SCORED = f"{_HYBRID}, scored AS (SELECT query_id, chunk_id, position, rrf_score, (('0x' || md5(query_id || '-' || chunk_id)[1:6])::BIGINT % 1000) / 1000.0::DOUBLE AS rerank_score FROM hyb)"


def _reranked(weight: float, threshold: float, floor: int, k: int = 5) -> str:
    order = f"round({weight}::DOUBLE / (60 + position) + 1.0::DOUBLE / (60 + rr), 12) DESC, least(position, rr), position" if weight else "rr, position"
    return f"""WITH {_SCORED}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS rr FROM scored WHERE position <= 20),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS fused_rank, count(*) FILTER (WHERE rerank_score >= {threshold}) OVER (PARTITION BY query_id) AS above FROM pool),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM f WHERE rerank_score >= {threshold} OR (above < {floor} AND fused_rank <= {floor}))
    SELECT query_id, chunk_id, rerank_score, CAST(fused_rank AS BIGINT) AS fused_rank, CAST(rank AS BIGINT) AS rank FROM kept WHERE rank <= {k}"""


@query(_reranked(1.0, 0.1, 3))
def rerank_fused(spark, sf_dir):
    return fusion.rerank(_scored(spark, sf_dir), CONFIG.top_k)


@query(_reranked(0, 0.5, 0))
def rerank_pure(spark, sf_dir):
    return fusion.rerank(_scored(spark, sf_dir), CONFIG.top_k, weight=0, threshold=0.5, min_keep=0)


@query(_reranked(1.0, 0.95, 3))
def rerank_threshold_floor(spark, sf_dir):
    return fusion.rerank(_scored(spark, sf_dir), CONFIG.top_k, threshold=0.95, min_keep=3)


@query(f"WITH {_SCORED} SELECT query_id, chunk_id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, position) AS place FROM scored) WHERE place <= 3")
def closest_matches(spark, sf_dir):
    return fusion.closest(_scored(spark, sf_dir))


@query(f"WITH {_RANKINGS}, pair AS (SELECT query_id, chunk_id, rank, 0 AS src FROM de UNION ALL SELECT query_id, chunk_id, rank, 1 FROM d2), once AS (SELECT query_id, chunk_id, min(rank * 2 + src) AS pos FROM pair GROUP BY ALL) SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM once) WHERE rank <= 10")
def round_robin_merge(spark, sf_dir):
    return fusion.round_robin(_dense_list(spark, sf_dir), _dense_list(spark, sf_dir, keep=F.col("label") % 2 == 0), 10)


# -- passages


def _grouped(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent_id"))
    return context.group_by_parent(sparse.bm25_topk(_questions(spark, sf_dir), d, CONFIG.bm25_k, "doc_id"), chunks)


_GROUPED = f"{_bm25()}, grp AS (SELECT query_id, source AS parent_id, min(rank) AS best_rank, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids FROM bm JOIN documents ON doc_id = chunk_id GROUP BY ALL)"


@query(f"WITH {_GROUPED} SELECT query_id, parent_id, CAST(best_rank AS BIGINT) AS best_rank, chunk_ids FROM grp")
def expand_parents_group(spark, sf_dir):
    return _grouped(spark, sf_dir).withColumn("chunk_ids", F.concat_ws(",", "chunk_ids"))


@query(
    f"""WITH RECURSIVE {_GROUPED}, item AS (SELECT query_id, parent_id, best_rank, 40 + (best_rank * 137) % 900 AS t, row_number() OVER (PARTITION BY query_id ORDER BY best_rank) AS i FROM grp),
    walk AS (SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS n, NULL::VARCHAR AS parent_id, NULL::BIGINT AS tokens, false AS cut, false AS took FROM (SELECT DISTINCT query_id FROM item)
        UNION ALL SELECT w.query_id, m.i::BIGINT, CASE WHEN used + t <= 700 THEN used + t WHEN n = 0 THEN 700 ELSE used END, CASE WHEN used + t <= 700 OR n = 0 THEN n + 1 ELSE n END, m.parent_id, CASE WHEN used + t <= 700 THEN t ELSE 700 END, used + t > 700, used + t <= 700 OR n = 0 FROM walk w JOIN item m ON m.query_id = w.query_id AND m.i = w.i + 1)
    SELECT query_id, n AS passage, parent_id, tokens, cut FROM walk WHERE took"""
)
def expand_parents_budget(spark, sf_dir):
    sized = _grouped(spark, sf_dir).withColumn("token_count", 40 + (F.col("best_rank") * 137) % 900)
    return context.within_budget(sized, 700)


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, CAST(ceil(least(400, n - 400 * x) / 4.0) AS BIGINT) AS t, x + 1 AS i FROM (SELECT doc_id, length(text) AS n, unnest(range(CAST(ceil(length(text) / 400.0) AS BIGINT))) AS x FROM documents)),
    walk AS (SELECT doc_id, 1::BIGINT AS i, t AS used, 1::BIGINT AS no FROM p WHERE i = 1 UNION ALL SELECT w.doc_id, p.i::BIGINT, CASE WHEN used > 0 AND used + t > 350 THEN t ELSE used + t END, CASE WHEN used > 0 AND used + t > 350 THEN no + 1 ELSE no END FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
    SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, CASE WHEN tokens <= 900 THEN 'single' ELSE 'map_reduce' END AS mode, CASE WHEN tokens <= 900 THEN 1 ELSE n END AS n_batches FROM (SELECT doc_id, max(no) AS n FROM walk GROUP BY 1) JOIN (SELECT doc_id, sum(t) AS tokens FROM p GROUP BY 1) USING (doc_id)"""
)
def summary_batches(spark, sf_dir):
    """Each document's windows of 100 tokens as its parents, with bounds small enough for them."""
    p = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.token_windows("text", 100)).alias("position", "text"))
    return context.summary_plan(p.withColumn("token_count", T.token_count("text")), 900, 350)


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS BIGINT) AS passage FROM documents")
def renumber_passages(spark, sf_dir):
    return context.renumber(load(spark, sf_dir, "documents"), ["lang", "doc_id"], "source").select("doc_id", "passage")


# -- answers


@query(
    r"""WITH src AS (SELECT doc_id, replace(replace(text, '. ', ' [' || doc_id % 9 || '–' || doc_id % 9 + 2 || ']. '), ', ', ' [' || length(text) % 40 || ', 7-4, 1-30], ') || ' year [2026] [99].' AS text FROM documents),
    parts AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '\[(\d{1,3}(?:\s*[,\-–]\s*\d{1,3})*)\]', 1), lambda m: string_split(regexp_replace(m, '\s+', '', 'g'), ','))) AS p FROM src),
    ends AS (SELECT doc_id, list_transform(p, lambda x: list_transform(string_split_regex(x, '[-–]'), lambda y: y::BIGINT)) AS e FROM parts),
    numbers AS (SELECT doc_id, flatten(list_transform(e, lambda x: CASE WHEN len(x) <> 2 THEN [x[1]] WHEN x[1] <= x[2] AND x[2] - x[1] <= 20 THEN range(x[1], x[2] + 1) ELSE x END)) AS n FROM ends)
    SELECT doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY f) AS cited FROM (SELECT doc_id, n, min(g) AS f FROM (SELECT doc_id, unnest(n) AS n, unnest(range(len(n))) AS g FROM numbers) GROUP BY doc_id, n) GROUP BY doc_id"""
)
def cited_indices(spark, sf_dir):
    """Marks after every sentence and clause of the documents: ranges, lists, a reversed and an overlong range, and a year that is none."""
    k, n = F.col("doc_id") % 9, F.length("text") % 40
    text = F.replace(F.col("text"), F.lit(". "), F.concat(F.lit(" ["), k.cast("string"), F.lit("–"), (k + 2).cast("string"), F.lit("]. ")))
    text = F.concat(F.replace(text, F.lit(", "), F.concat(F.lit(" ["), n.cast("string"), F.lit(", 7-4, 1-30], "))), F.lit(" year [2026] [99]."))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", T.cited(text)).alias("cited"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, '[]', '()'), '[ \t]*!', '!', 'g'), '\.', ' [' || CASE WHEN doc_id % 5 = 2 THEN '1][2' ELSE '2' END || '].', 'g')) AS text FROM documents")
def strip_invalid_markers(spark, sf_dir):
    """Marks of passages that are there and that aren't, after every sentence of the documents."""
    text = F.regexp_replace(F.translate(F.col("text"), "[]", "()"), "!", " [7]!")
    text = F.replace(text, F.lit("."), F.when(F.col("doc_id") % 5 == 2, F.lit(" [1-2, 9].")).otherwise(F.lit(" [9, 2, 2].")))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.valid_markers(text, F.array(F.lit(1), F.lit(2)))).alias("text"))


@query("SELECT conv_id, turn, lower(trim(text)) LIKE 'i couldn''t find this in your documents%' OR turn % 3 = 0 AS refused FROM conversations")
def refusal_flag(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, F.lit('"I couldn’t  find this in your documents.” Sorry.')).otherwise(F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_refusal(text).alias("refused"))


@query("SELECT conv_id, turn, regexp_matches(CASE WHEN turn = 1 THEN 'Hi there!' ELSE text END, '" + T.GREETING + "') AS greeting FROM conversations")
def router_greeting(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_greeting(F.when(F.col("turn") == 1, F.lit("Hi there!")).otherwise(F.col("text"))).alias("greeting"))


@query(
    "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(trim(text)) > 200 THEN substr(trim(text), 1, 200) || ' …' ELSE trim(text) END, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 6 GROUP BY conv_id"
)
def history_last_n(spark, sf_dir):
    return context.history(load(spark, sf_dir, "conversations"), CONFIG.history_turns, 200)


def _scrubbed(x: str) -> str:
    for pattern in T.SECRETS:
        x = f"regexp_replace({x}, '{pattern}', '***', 'g')"
    return x


@query(f"""SELECT doc_id, md5({_scrubbed("replace(replace(text, ' in ', ' Bearer ' || md5(text) || ' '), '. ', '. AIza' || md5(lang) || ' gho_' || md5(source) || ' ')")}) AS line, md5({_scrubbed("text")}) AS own, '<redacted ' || length(text) || ' chars>' AS content FROM documents""")
def scrub_secrets(spark, sf_dir):
    """The documents as they are, and with keys put in at every sentence."""
    line = F.replace(F.col("text"), F.lit(" in "), F.concat(F.lit(" Bearer "), F.md5("text"), F.lit(" ")))
    line = F.replace(line, F.lit(". "), F.concat(F.lit(". AIza"), F.md5("lang"), F.lit(" gho_"), F.md5("source"), F.lit(" ")))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.scrub(line)).alias("line"), F.md5(T.scrub("text")).alias("own"), T.redact(F.lit("content"), "text").alias("content"))


@query()
def ask_batch(spark, sf_dir):
    """All benchmark questions answered from all documents, chunked and embedded, in one plan."""
    engine = Engine.build(_documents(spark, sf_dir), CONFIG)
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("request_id"), "text")
    out = engine.ask(asked)
    return out.select("request_id", "route", "answer", "refused", "grounded", F.size("citations").alias("n_citations"))


@query(
    "WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 50 = 0 DESC, source || '.txt', doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents) SELECT lang AS collection, string_agg(n || '. T' || doc_id || ' (' || source || '.txt)', chr(10) ORDER BY n) || CASE WHEN any_value(c) > 20 THEN chr(10) || '... and ' || any_value(c) - 20 || ' more' ELSE '' END AS listing FROM d WHERE n <= 20 GROUP BY lang"
)
def catalog_order(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    d = d.select("doc_id", F.col("lang").alias("collection"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.concat("source", F.lit(".txt")).alias("filename"), (F.col("doc_id") % 50 == 0).alias("recent"))
    return rendering.catalog(d, most=20)


@query(
    "WITH v AS (SELECT conv_id AS request_id, turn AS pos, trim(trim(text), '\"''“”‘’`') AS t FROM conversations), o AS (SELECT request_id, min(pos) AS p, arg_min(trim(t), pos) AS text FROM v WHERE trim(t) <> '' GROUP BY request_id, lower(trim(t))) SELECT request_id, CAST(n AS BIGINT) AS pos, text FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p) AS n FROM o) WHERE n <= 3"
)
def clean_variants(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.lit("?").alias("question"), F.col("turn").alias("pos"), F.concat(F.lit(' "'), "text", F.lit('" ')).alias("text"))
    return rendering.variants(c)


@query("SELECT 'q' || lpad(CAST(row_number() OVER (ORDER BY p) AS VARCHAR), 3, '0') AS id, question FROM (SELECT min(doc_id) AS p, arg_min(question, doc_id) AS question FROM (SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN ' *X*' ELSE ' x' END AS question FROM documents) GROUP BY lower(trim(regexp_replace(regexp_replace(question, '[|*_`#>]', ' ', 'g'), '\\s+', ' ', 'g'))))")
def question_dedup(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.concat("source", F.when(F.col("doc_id") % 2 == 0, " *X*").otherwise(" x")).alias("question"))
    return rendering.distinct_questions(d)


@query("SELECT doc_id, doc_id % 3 AS n, source AS name FROM documents")
def parse_structured(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct((F.col("doc_id") % 3).alias("n"), F.col("source").alias("name"))), F.lit("\n```"))
    return d.select("doc_id", rendering.structured(reply, "n long, name string").alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, '<passage id=\"1\" source=\"' || source || '.txt | p. 2-3 | ' || lang || '\">' || chr(10) || text || chr(10) || '</passage>' AS block FROM documents")
def format_passages(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("file", F.concat("source", F.lit(".txt"))).withColumn("a", F.lit(2)).withColumn("b", F.lit(3))
    p = F.array(F.struct(F.lit(1).alias("passage"), rendering.passage_label("file", "a", "b", "lang").alias("source"), F.col("text")))
    return d.select("doc_id", rendering.passages_block(p).alias("block"))


@query("SELECT lang AS collection, count(*) AS documents, CAST(sum(n_chars % 17) AS BIGINT) AS chunks, count(DISTINCT source) AS sources, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY lang")
def kb_stats(spark, sf_dir):
    d = _registered(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy("collection").agg(F.count("*").alias("documents"), F.sum("num_chunks").alias("chunks"), F.countDistinct("source").alias("sources"), F.countDistinct("content_hash").alias("texts"))


# -- registry


def _registered(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id"), F.col("lang").alias("collection"), (F.col("n_chars") % 17).alias("num_chunks"), F.md5("text").alias("content_hash"), F.when(F.col("doc_id") % 10 == 0, "url").otherwise("text").alias("source_type"))


@query("SELECT name, version, count(doc_id) AS documents, CAST(coalesce(sum(n_chars % 17), 0) AS BIGINT) AS chunks FROM (SELECT DISTINCT lang AS name, CAST(1 AS BIGINT) AS version FROM documents UNION ALL SELECT 'empty', 7) LEFT JOIN documents ON lang = name GROUP BY ALL")
def registry_counts(spark, sf_dir):
    d = _registered(spark, sf_dir)
    names = d.select(F.col("collection").alias("name")).distinct().withColumn("version", F.lit(1).cast("long")).union(spark.createDataFrame([("empty", 7)], "name string, version long"))
    return registry.collection_counts(names, d)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("f")).select("o_custkey", "f.*")
    return registry.upsert(old, o, ["o_custkey"], "o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0")
def prune_anti_join(spark, sf_dir):
    d = _registered(spark, sf_dir)
    return registry.missing(d, d.where("doc_id % 7 <> 0"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents")
def ingest_diff(spark, sf_dir):
    d = _registered(spark, sf_dir)
    scan = d.where("doc_id % 3 = 0 OR doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("content_hash")))
    return registry.difference(d.where("doc_id % 3 <> 0"), scan)


@query("SELECT lang, count(*) AS chunks, count(*) FILTER (WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) AS reused FROM documents GROUP BY lang")
def vector_reuse(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", T.short_hash("text").alias("embed_hash"))
    had, new = registry.reuse_vectors(d, d.where("doc_id % 2 = 0").withColumn("embedding", F.lit(0)))
    both = had.select("lang", F.lit(1).alias("r")).unionAll(new.select("lang", F.lit(0).alias("r")))
    return both.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum("r").alias("reused"))


# -- answer cache


def _cache(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0")
    return e.select(F.col("vec_id").alias("id"), F.lit("kb").alias("collection"), (F.col("label") % 2).cast("long").alias("kb_version"), F.lit("f").alias("fingerprint"), F.format_string("Revenue in Q%d?", F.col("vec_id") % 2).alias("question"), "embedding")


def _cache_questions(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").where("vec_id % 3 = 0")
    return e.select(F.col("vec_id").alias("request_id"), F.lit("kb").alias("collection"), (F.col("label") % 2).cast("long").alias("kb_version"), F.lit("f").alias("fingerprint"), F.format_string("What was revenue in Q%d?", F.col("label") % 2).alias("question"), "embedding")


_CACHE = """met AS (SELECT q.vec_id AS request_id, c.vec_id AS id, round(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE)), 9) AS s, q.label % 2 = c.vec_id % 2 AS same FROM embeddings q JOIN embeddings c ON q.label % 2 = c.label % 2 WHERE q.vec_id % 3 = 0 AND c.vec_id % 3 <> 0),
    agg AS (SELECT request_id, arg_max(id, s) FILTER (WHERE same AND s >= 0.3) AS hit_id, max(s) FILTER (WHERE same AND s >= 0.3) AS hs, count(*) AS candidates, max(s) AS m, arg_max(same, s) AS best_same FROM met GROUP BY 1)"""


@query(f"WITH {_CACHE} SELECT request_id, hit_id, round(coalesce(hs, m, 0), 6) AS similarity, candidates, hs IS NULL AND m >= 0.3 AND NOT best_same AS blocked FROM agg")
def cache_lookup(spark, sf_dir):
    return answer_cache.lookup(_cache_questions(spark, sf_dir), _cache(spark, sf_dir), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_CACHE} SELECT 'kb' AS collection, count(*) AS lookups, count(hit_id) AS hits FROM agg")
def cache_hit_rate(spark, sf_dir):
    return answer_cache.counters(answer_cache.lookup(_cache_questions(spark, sf_dir), _cache(spark, sf_dir), 0.3).withColumn("collection", F.lit("kb")))


@query("SELECT user_id AS collection, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 10 DAY ELSE ts END DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def cache_lru_evict(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("collection"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("last_hit_at"))
    return answer_cache.evict(e, 20).select("collection", "id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0 AND label % 2 = 1 UNION ALL SELECT CAST(-1 AS BIGINT)")
def cache_invalidate(spark, sf_dir):
    c = _cache(spark, sf_dir).select("id", "collection", "kb_version", F.lit(None).cast("timestamp").alias("last_hit_at"), F.lit("2026-01-01").cast("timestamp").alias("created_at"))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("kb").alias("collection"), F.lit(1).cast("long").alias("kb_version"), F.lit(None).cast("timestamp").alias("last_hit_at"), F.lit("2026-01-02").cast("timestamp").alias("created_at"))
    return answer_cache.put(c, new, 1_000_000_000).select("id")


# -- evaluation


@query(f"SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains({_quotable('d.text')}, {_quotable('b.text')})")
def gold_resolve(spark, sf_dir):
    q = load(spark, sf_dir, "benchmark").select("item_id", T.quotable("text").alias("quote"))
    d = load(spark, sf_dir, "documents").select("doc_id", T.quotable("text").alias("text"))
    return evaluation.quoted_in(q, d)


_GOLD = f"{_bm25()}, gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b, documents d WHERE contains({_quotable('d.text')}, {_quotable('b.text')}))"


@query(
    f"""WITH {_GOLD}, r AS (SELECT bm.query_id, rank, g.chunk_id IS NOT NULL AS good FROM bm LEFT JOIN gold g ON g.query_id = bm.query_id AND g.chunk_id = bm.chunk_id WHERE rank <= 5), p AS (SELECT *, sum(good::INT) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS prec FROM r)
    SELECT q.query_id, coalesce(max(good::INT), 0)::DOUBLE AS hit, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE good), 0), 6) AS reciprocal_rank, round(coalesce(avg(prec) FILTER (WHERE good), 0), 6) AS average_precision FROM (SELECT DISTINCT query_id FROM gold) q LEFT JOIN p USING (query_id) GROUP BY q.query_id"""
)
def retrieval_metrics(spark, sf_dir):
    ranked = sparse.bm25_topk(_questions(spark, sf_dir), load(spark, sf_dir, "documents"), CONFIG.bm25_k, "doc_id")
    gold = gold_resolve(spark, sf_dir).toDF("query_id", "chunk_id")
    m = evaluation.rank_metrics(ranked, gold, CONFIG.top_k)
    return m.select("query_id", "hit", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("average_precision", 6).alias("average_precision"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((value > 50)::INT), 6) AS slow FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.round(evaluation.quantile("value", 50), 6).alias("p50"), F.round(evaluation.quantile("value", 95), 6).alias("p95"), F.round(evaluation.share(F.col("value") > 50), 6).alias("slow"))


def _results(spark, sf_dir):
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("event_type").alias("config"), i.alias("item_id"), F.when(i % 4 == 0, "unanswerable").when(i % 4 == 1, "fact").otherwise("numeric").alias("kind"), (i % 4 != 0).alias("answerable"), (i % 5 == 0).alias("refused"),
        (i % 3 == 0).cast("double").alias("hit"), (1.0 / (1 + i % 6)).alias("reciprocal_rank"), ((i % 7) / 7.0).alias("context_precision"), ((i % 2) / 2.0).alias("context_recall"), F.when(i % 5 != 0, (i % 9) / 9.0).alias("faithfulness"), ((i % 4) / 4.0).alias("answer_relevance"),
        F.col("value").alias("latency_ms"), (F.col("value") / 1000).alias("cost_usd"), F.when(i % 11 != 0, i % 3).alias("retries"), (i % 2).alias("fallbacks"), F.when(i % 13 == 0, "quota").alias("error"),
    )


_RESULTS = """res AS (SELECT event_type AS config, event_id AS i, CASE WHEN event_id % 4 = 0 THEN 'unanswerable' WHEN event_id % 4 = 1 THEN 'fact' ELSE 'numeric' END AS kind, event_id % 4 <> 0 AS yes, event_id % 5 = 0 AS refused, (event_id % 3 = 0)::INT::DOUBLE AS hit, value, event_id % 13 <> 0 AS ok,
    coalesce(event_id % 11 <> 0 AND event_id % 3 + event_id % 2 = 0, false) AS clean FROM events)"""


@query(
    f"""WITH {_RESULTS} SELECT config, count(*) AS questions, count(*) FILTER (WHERE NOT ok) AS errors, round(avg(hit) FILTER (WHERE ok AND yes), 6) AS hit, round(avg(1.0::DOUBLE / (1 + i % 6)) FILTER (WHERE ok AND yes), 6) AS reciprocal_rank, round(avg((i % 7) / 7.0::DOUBLE) FILTER (WHERE ok AND yes), 6) AS context_precision,
    round(avg((i % 2) / 2.0::DOUBLE) FILTER (WHERE ok AND yes), 6) AS context_recall, round(avg((i % 9) / 9.0::DOUBLE) FILTER (WHERE ok AND i % 5 <> 0), 6) AS faithfulness, round(avg((i % 4) / 4.0::DOUBLE) FILTER (WHERE ok AND yes), 6) AS answer_relevance, round(avg(refused::INT) FILTER (WHERE ok AND NOT yes), 6) AS correct_refusals, round(avg(refused::INT) FILTER (WHERE ok AND yes), 6) AS false_refusals,
    round(quantile_cont(value, 0.5) FILTER (WHERE ok), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE ok), 6) AS p95, round(quantile_cont(value, 0.5) FILTER (WHERE ok AND clean), 6) AS clean_p50, round(quantile_cont(value, 0.95) FILTER (WHERE ok AND clean), 6) AS clean_p95, count(*) FILTER (WHERE ok AND NOT clean) AS throttled, round(avg(value / 1000) FILTER (WHERE ok), 9) AS cost_usd FROM res GROUP BY config"""
)
def config_summary(spark, sf_dir):
    return evaluation.summarize(_results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT config, " + ", ".join(f"round(avg(CASE WHEN yes THEN hit ELSE (NOT refused)::INT::DOUBLE END) FILTER (WHERE ok AND kind = '{k}'), 6) AS {k}" for k in ("unanswerable", "fact", "numeric")) + " FROM res GROUP BY config")
def kind_pivot(spark, sf_dir):
    return evaluation.by_kind(_results(spark, sf_dir), ["unanswerable", "fact", "numeric"])


@query("SELECT event_type AS config, user_id AS item_id, max(event_id) AS line_no FROM events GROUP BY ALL")
def checkpoint_latest(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("config"), F.col("user_id").alias("item_id"), F.col("event_id").alias("line_no"))
    return evaluation.latest(e)


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM documents WHERE ceil(n_chars / 4.0) >= 40) SELECT doc_id FROM d WHERE i IN (SELECT floor(x * c / 20) FROM range(20) t(x), (SELECT DISTINCT c FROM d))")
def even_sample(spark, sf_dir):
    return evaluation.even_sample(load(spark, sf_dir, "documents").where(T.token_count("text") >= 40).select("doc_id"), 20, "doc_id")


@query("WITH s AS (SELECT source || lang AS heading, n_chars % 50 AS doc_id, doc_id AS position, row_number() OVER (PARTITION BY source || lang ORDER BY n_chars % 50, doc_id) AS r FROM documents) SELECT a.heading, a.doc_id AS doc_id_1, a.position AS position_1, b.doc_id AS doc_id_2, b.position AS position_2 FROM s a JOIN s b ON a.heading = b.heading AND a.r = 1 AND b.r = 2 WHERE a.doc_id <> b.doc_id")
def cross_doc_pairs(spark, sf_dir):
    return evaluation.cross_pairs(load(spark, sf_dir, "documents").select(F.concat("source", "lang").alias("heading"), (F.col("n_chars") % 50).alias("doc_id"), F.col("doc_id").alias("position")))


# -- usage and limits


def _usage(spark, sf_dir):
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    u = e.select("user_id", F.concat(F.lit("model-"), (i % 4).cast("string")).alias("model"), (i % 1000).alias("prompt_tokens"), (i % 300).alias("output_tokens"), F.when(i % 2 == 0, i % 50).alias("thoughts_tokens"))
    return usage.with_cost(u, spark.createDataFrame([("model-0", 0.3, 2.5), ("model-1", 0.1, 0.4), ("model-2", 0.75, 3.75)], "model string, input_per_m double, output_per_m double"))


_USAGE = "usage AS (SELECT 'model-' || event_id % 4 AS model, event_id % 1000 AS prompt_tokens, event_id % 300 AS output_tokens, coalesce(CASE event_id % 4 WHEN 0 THEN (event_id % 1000 * 0.3::DOUBLE + (event_id % 300 + coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 50 END, 0)) * 2.5::DOUBLE) / 1e6 WHEN 1 THEN (event_id % 1000 * 0.1::DOUBLE + event_id % 300 * 0.4::DOUBLE) / 1e6 WHEN 2 THEN (event_id % 1000 * 0.75::DOUBLE + (event_id % 300 + event_id % 50) * 3.75::DOUBLE) / 1e6 END, 0) AS cost_usd FROM events)"


@query(f"WITH {_USAGE} SELECT model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM usage GROUP BY ROLLUP (model)")
def usage_totals_rollup(spark, sf_dir):
    return usage.totals(_usage(spark, sf_dir), "model")


def _requests(events):
    return events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit(1).alias("cost"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    walk AS (SELECT user_id, event_id, i, sec, [sec] AS times, true AS allowed FROM r WHERE i = 1
        UNION ALL SELECT user_id, event_id, i, sec, CASE WHEN len(kept) < 3 THEN list_append(kept, sec) ELSE kept END, len(kept) < 3 FROM (SELECT r.*, list_filter(w.times, lambda t: t > r.sec - 86400.0::DOUBLE) AS kept FROM walk w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1))
    SELECT user_id, event_id, allowed, round(CASE WHEN len(times) >= 3 THEN greatest(0.0::DOUBLE, times[1] + 86400.0::DOUBLE - sec) ELSE 0.0::DOUBLE END, 6) AS retry_after FROM walk"""
)
def rate_limit_decisions(spark, sf_dir):
    return usage.decide(_requests(load(spark, sf_dir, "events")), 3, 86_400.0)


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, so that a lone file will do


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    t = streams.drained(streams.tumbling(_stream(spark, sf_dir)), "lodestone_tumbling")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT h - o * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h, event_type, unnest([0, 1]) AS o FROM events) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return streams.drained(streams.sliding(_stream(spark, sf_dir)), "lodestone_sliding").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session(spark, sf_dir):
    s = streams.stored(streams.sessions(_stream(spark, sf_dir)))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
