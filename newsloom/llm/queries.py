"""Registered queries of the operators in this folder, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import alignment, decontaminate, exact_dedup, language_id, lattice_lm, lexical_search, licenses, mixing, near_dedup, quotes, simhash, toxicity, warc
from newsloom.llm.common import is_held_out, table

NORM_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_held_out(F.col("doc_id"), 4, 2)
    profiles = language_id.learn_profiles(docs.filter(~held_out).select("text", "lang"))
    return language_id.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, {NORM_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = is_held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_held_out(F.col("doc_id"), 5, 1)
    scored = lattice_lm.score_documents(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({NORM_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
           FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (n + m - k)),
e AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen)
SELECT s.doc_id, len(s) AS n_shingles, min(seen) AS component_id, s.doc_id = min(seen) AS kept
FROM s JOIN reach ON node = s.doc_id GROUP BY s.doc_id, s
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({NORM_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({NORM_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n),
hits AS (
  SELECT rid, i, p.n, item
  FROM (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM places) AS q JOIN phrases AS p USING (n, phrase)),
covered AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, array_to_string([lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0') FOR i IN range(1, 41)], '') AS b FROM q)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string([chr(CAST(CASE WHEN v < 26 THEN 65 + v ELSE 24 + v END AS INTEGER))
         FOR v IN [list_sum([CASE WHEN b[5 * i + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END FOR j IN range(0, 5)]) FOR i IN range(0, 32)]], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_TERMS = f"regexp_extract_all({NORM_SQL}, '{lexical_search.TERM}')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {OP11_TERMS} AS w FROM documents),
sizes AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM d),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY rid, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, sizes GROUP BY t),
items AS (SELECT DISTINCT item_id, unnest({OP11_TERMS}) AS t FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM items JOIN tf USING (t) JOIN weights USING (t), sizes GROUP BY item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op10_warc": op10_warc, "op11_lexical_search": op11_lexical_search, "op12_align_tokens": op12_align_tokens, "op13_simhash": op13_simhash, "op2_lm_score": op2_lm_score, "op3_near_dedup": op3_near_dedup, "op4_mix_sources": op4_mix_sources, "op5_quote_links": op5_quote_links, "op6_decontaminate": op6_decontaminate, "op7_language_id": op7_language_id, "op8_exact_dedup": op8_exact_dedup, "op9_license_scan": op9_license_scan}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10_SQL, "op11_lexical_search": OP11_SQL, "op3_near_dedup": OP3_SQL, "op5_quote_links": quotes.ORACLE_SQL, "op6_decontaminate": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op9_license_scan": licenses.oracle_sql()}
