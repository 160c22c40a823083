"""The registered queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.minhash_dedup import near_duplicates
from graphloom.llm.ngram_leaks import find_leaks
from graphloom.llm.piece_chunks import encode_pieces
from graphloom.llm.schema_rewrite import rewrite_drifted
from graphloom.llm.source_divergence import audit_sources
from graphloom.llm.source_mix import mix_sources, words_taken
from graphloom.llm.substrings import dedup_byte_strings, dedup_word_windows
from graphloom.llm.token_counts import count_tokens
from graphloom.llm.toxicity import fit, grade_toxicity, labelled_sample
from graphloom.llm.url_rules import filter_urls, parse_rule
from graphloom.llm.vector_links import link_vectors
from graphloom.llm.warc_zstd import archive_folder, read_archives, write_archives

#: The URL rules of op 6.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    length = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", length("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (length("spans") > 0).alias("contaminated"), length("bytes").alias("hit_bytes")
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, similarity=80)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_word_windows(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_byte_strings(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), [parse_rule(v, r) for v, r in URL_RULES])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return grade_toxicity(docs, fit(labelled_sample(docs, _table(spark, sf_dir, "labels"))))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(mix_sources(_table(spark, sf_dir, "documents")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    archives = write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite_drifted(_table(spark, sf_dir, "clients"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1,
        "op2_token_counts": op2,
        "op3_minhash_dedup": op3,
        "op4_substring_dedup": op4,
        "op5_suffix_array_dedup": op5,
        "op6_url_filter": op6,
        "op7_toxicity": op7,
        "op8_embedding_dedup": op8,
        "op9_source_mix": op9,
        "op10_warc": op10,
        "op11_sentencepiece": op11,
        "op12_schema_rewrite": op12,
        "op13_source_divergence": op13,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_GAP = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LETTERS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(_TEXT)}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format(_TEXT)}, {_ALNUM}) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM pos) p JOIN win ON p.k = win.k AND p.n = win.n),
place AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS x FROM hit),
words AS (SELECT doc_id, count(*) AS n_hit FROM place GROUP BY doc_id),
gaps AS (SELECT doc_id, regexp_extract_all(low, {_GAP}) AS g, CAST(regexp_matches(low, '^' || {_GAP}) AS INT) AS lead_ FROM (SELECT doc_id, {_LOWER.format(_TEXT)} AS low FROM documents)),
size AS (SELECT p.doc_id, CAST(sum(strlen(w[p.x]) + CASE WHEN nxt.x IS NULL THEN 0 ELSE strlen(g[p.x + lead_]) END) AS BIGINT) AS hit_bytes
  FROM place p JOIN d ON d.doc_id = p.doc_id JOIN gaps ON gaps.doc_id = p.doc_id LEFT JOIN place nxt ON nxt.doc_id = p.doc_id AND nxt.x = p.x + 1 GROUP BY p.doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated, coalesce(size.hit_bytes, 0) AS hit_bytes
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN size USING (doc_id)
"""

_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(_TEXT)}, {_SPACED}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""

_OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_TEXT}, {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM win JOIN first USING (k) WHERE least < doc_id GROUP BY doc_id),
flags AS (SELECT d.doc_id, w, coalesce(g, []) AS g FROM d LEFT JOIN gone USING (doc_id)),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) p
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS gd, unnest(g) AS gi FROM gone) q WHERE gd = p.doc_id AND gi = p.i) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(len(f.g) AS BIGINT) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM flags f LEFT JOIN left_ l USING (doc_id)
"""

_OP6 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, h, q) AS (VALUES {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)}),
f AS (SELECT page_id, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1
"""

_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS ok
  FROM embeddings),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND p.ok AND q.ok WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
t AS (SELECT body, max(page_id) AS top FROM p GROUP BY body),
bits AS (SELECT page_id, strlen(p.body) AS payload_bytes, top,
  array_to_string(list_transform(string_split(sha1(p.body), ''), lambda c: right('000' || format('{:b}', strpos('0123456789abcdef', c) - 1), 4)), '') AS b
  FROM p JOIN t ON p.body = t.body)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(substr(b, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INTEGER)
    + 2 * CAST(substr(b, 5 * i + 4, 1) AS INTEGER) + CAST(substr(b, 5 * i + 5, 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits
"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TEXT} AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, {_LETTERS})) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT i, lang, term FROM w) GROUP BY lang, term HAVING count(*) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
big AS (SELECT lang, sum(n) AS big FROM n GROUP BY lang),
total AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (total + v) AS BIGINT) AS p
  FROM g JOIN kept USING (lang) JOIN total USING (lang, source) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(big) + any_value(v)) AS BIGINT) AS q FROM n JOIN big USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express in reasonable time; the others are tested against brute force in tests/llm."""
    return {
        "op1_benchmark_decontamination": _OP1,
        "op3_minhash_dedup": _OP3,
        "op4_substring_dedup": _OP4,
        "op6_url_filter": _OP6,
        "op8_embedding_dedup": _OP8,
        "op10_warc": _OP10,
        "op13_source_divergence": _OP13,
    }
