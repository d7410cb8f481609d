"""Text, address and date functions (B rows)."""

from pyspark.sql import functions as F

from newsloom.functions import dates, text as X
from newsloom.functions.urls import canonical_url, host, is_public_url
from newsloom.operators.dedup import exact_duplicates
from newsloom.plans.showcase.base import AS_OF, DOCS_CTE, docs, sql_str, table

_RAW_URL_SQL = """
raw AS (
  SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END
         || 'utm_source=feed&k=' || page_id || '&empty=&GCLID=7' AS u FROM pages
),
parts AS (
  SELECT page_id, regexp_extract(u, '^([a-z]+)://([^/?#]*)([^?#]*)\\?(.*)$', ['scheme', 'auth', 'path', 'query']) AS p FROM raw
),
canon AS (
  SELECT page_id, lower(p.scheme) || '://' || lower(p.auth)
         || CASE WHEN regexp_replace(regexp_replace(p.path, '/{2,}', '/', 'g'), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(p.path, '/{2,}', '/', 'g'), '/+$', '') END
         || '?' || array_to_string(list_filter(string_split(p.query, '&'), lambda x: NOT list_contains(['utm_source', 'gclid'], lower(split_part(x, '=', 1)))), '&') AS canonical_url,
         lower(p.auth) AS host
  FROM parts
)"""


def _raw_urls(spark, sf):
    base = F.substring_index("url", "#", 1)
    sep = F.when(base.contains("?"), "&").otherwise("?")
    return table(spark, sf, "pages").select(
        "page_id", F.concat(base, sep, F.lit("utm_source=feed&k="), F.col("page_id").cast("string"), F.lit("&empty=&GCLID=7#x")).alias("u")
    )


def canonical_urls(spark, sf):
    return _raw_urls(spark, sf).select("page_id", canonical_url(F.col("u")).alias("canonical_url"))


def page_host_counts(spark, sf):
    u = _raw_urls(spark, sf)
    return u.filter(is_public_url(F.col("u"))).groupBy(host(F.col("u")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def content_digests(spark, sf):
    return docs(spark, sf).select("doc_id", X.content_digest(F.col("text"), F.lit("")).alias("digest"))


def exact_duplicate_groups(spark, sf):
    d = docs(spark, sf).select("doc_id", X.content_digest(F.col("text"), F.lit("")).alias("digest"), "fetched_at")
    out = exact_duplicates(d, "digest", "doc_id", "fetched_at").filter("copies > 1")
    return out.select("digest", "leader_seq", "copies", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


def dedupe_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", X.dedupe_hash(F.col("title"), F.col("published_at"), F.col("source")).alias("dedupe_hash"))


def rule_summaries(spark, sf):
    return docs(spark, sf).select("doc_id", X.rule_summary(F.col("text")).alias("summary"))


def money_token_list(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.money_tokens(F.col("text")), "|").alias("money"))


def percent_first(spark, sf):
    pct = X.percent_tokens(F.col("text"))
    return docs(spark, sf).select("doc_id", F.get(pct, F.lit(0)).alias("first_percent"), F.size(pct).cast("bigint").alias("n")).filter("n > 0")


def stable_titles(spark, sf):
    return docs(spark, sf).select(
        "doc_id", X.stable_text(F.col("title")).alias("stable"), X.display_title(F.col("title")).alias("display_title"), X.evidence_excerpt(F.col("text")).alias("excerpt")
    )


def entity_name_keys(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit(" ("), F.col("s_name"), F.lit(") — Works/No_"), F.col("s_suppkey").cast("string"), F.lit("，")).alias("raw"))
    c = table(spark, sf, "customer").select(F.concat(F.col("c_name"), F.lit(" · "), F.col("c_mktsegment")).alias("raw"))
    return s.unionByName(c).select("raw", X.clean_entity_name(F.col("raw")).alias("clean_name"), X.name_key(F.col("raw")).alias("name_key"))


_DATE_TEXT = {
    "export": """CASE o_orderkey % 7 WHEN 0 THEN CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS VARCHAR)
        WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d 10:20:30') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d 07:08:09')
        WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT23:30:00+02:00') ELSE 'unknown' END""",
}


def export_dates(spark, sf):
    at = F.col("o_orderdate")
    k = F.col("o_orderkey") % 7
    sec = F.unix_seconds(at.cast("timestamp"))
    raw = (
        F.when(k == 0, sec.cast("string")).when(k == 1, (sec * 1000).cast("string")).when(k == 2, F.date_format(at, "yyyy/MM/dd"))
        .when(k == 3, F.date_format(at, "yyyy/MM/dd' 10:20:30'")).when(k == 4, F.date_format(at, "yyyy-MM-dd' 07:08:09'"))
        .when(k == 5, F.date_format(at, "yyyy-MM-dd'T23:30:00+02:00'")).otherwise("unknown")
    )
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(dates.parse_export_date(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def page_dates(spark, sf):
    at = F.col("o_orderdate") + F.expr("make_dt_interval(9000)")
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.date_format(at, "yyyy年M月d日' 8:05'")).when(k == 1, F.date_format(at, "'on 'yyyy.MM.dd' 21:07:30'"))
        .when(k == 2, F.date_format(at, "yyyy/M/d")).otherwise("no date")
    )
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(dates.parse_page_date(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def list_dates(spark, sf):
    at = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format(at, "'[ 'M'月'd'日 ]'")).when(k == 1, F.date_format(at, "'news 'MM-dd")).otherwise(F.concat(F.lit("2023 年 "), F.date_format(at, "M'月'd"), F.lit("日")))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(dates.parse_list_date(raw, AS_OF), "yyyy-MM-dd").alias("parsed"))


QUERIES = {
    "canonical_url": canonical_urls,
    "page_host_counts": page_host_counts,
    "content_digest": content_digests,
    "exact_duplicates": exact_duplicate_groups,
    "dedupe_hash": dedupe_hashes,
    "rule_summary": rule_summaries,
    "money_tokens": money_token_list,
    "percent_first": percent_first,
    "stable_text": stable_titles,
    "entity_name_keys": entity_name_keys,
    "export_dates": export_dates,
    "page_dates": page_dates,
    "list_dates": list_dates,
}

_SP = "'[\\s\\p{Z}\\x{85}\\x1c-\\x1f]+'"
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, {_SP}, ' ', 'g'))"
_MONEY = sql_str("(?:usd|eur|rmb|cny|sar|aed|美元|欧元|人民币)?[\\s\\p{Z}]*\\d+(?:[.,]\\d+)?[\\s\\p{Z}]*(?:亿|万|million|billion)?")

ORACLE = {
    "canonical_url": f"WITH {_RAW_URL_SQL} SELECT page_id, canonical_url FROM canon",
    "page_host_counts": f"WITH {_RAW_URL_SQL} SELECT host, count(*) AS pages FROM canon GROUP BY 1",
    "content_digest": f"WITH {DOCS_CTE} SELECT doc_id, hash_key AS digest FROM d",
    "exact_duplicates": f"""WITH {DOCS_CTE} SELECT hash_key AS digest, min(doc_id) AS leader_seq, count(*) AS copies, strftime(max(fetched_at), '%Y-%m-%d') AS last_seen
        FROM d GROUP BY 1 HAVING count(*) > 1""",
    "dedupe_hash": f"""WITH {DOCS_CTE} SELECT doc_id, sha256(concat_ws('|', lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')),
        coalesce(strftime(published_at, '%Y-%m-%d'), 'unknown'), source)) AS dedupe_hash FROM d""",
    "rule_summary": f"""WITH s AS (
          SELECT doc_id, trim(array_to_string(list_transform(list_slice(regexp_extract_all({_SQUEEZE('text')}, '[^。！？.!?]*[。！？.!?] *|[^。！？.!?]+$'), 1, 3), lambda x: rtrim(x)), '')) AS chosen FROM documents)
        SELECT doc_id, CASE WHEN length(chosen) > 180 THEN regexp_replace(substr(chosen, 1, 180), '[，,；; ]+$', '') || '…' ELSE chosen END AS summary FROM s""",
    "money_tokens": f"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(lower(text), {_MONEY}), 1, 2), '|') AS money FROM documents",
    "percent_first": r"""SELECT doc_id, p[1] AS first_percent, CAST(len(p) AS BIGINT) AS n FROM (SELECT doc_id, regexp_extract_all(text, '\d+(?:\.\d+)?%') AS p FROM documents) WHERE len(p) > 0""",
    "stable_text": f"""WITH {DOCS_CTE} SELECT doc_id, regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '', 'g') AS stable,
        trim(regexp_replace(title, {_SP}, ' ', 'g'), ' -—|') AS display_title, substr({_SQUEEZE('text')}, 1, 500) AS excerpt FROM d""",
    "entity_name_keys": """WITH r AS (SELECT ' (' || s_name || ') — Works/No_' || s_suppkey || '，' AS raw FROM supplier UNION ALL SELECT c_name || ' · ' || c_mktsegment FROM customer),
        c AS (SELECT raw, trim(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' 。、，；') AS clean_name FROM r)
        SELECT raw, clean_name, regexp_replace(lower(clean_name), '[\\s，（）()·•—/_-]+', '', 'g') AS name_key FROM c""",
    "export_dates": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 10:20:30') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d 07:08:09')
        WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d 21:30:00') WHEN 6 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS parsed FROM orders""",
    "page_dates": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(ats, '%Y-%m-%d 08:05:00') WHEN 1 THEN strftime(ats, '%Y-%m-%d 21:07:30')
        WHEN 2 THEN strftime(ats, '%Y-%m-%d 00:00:00') END AS parsed
        FROM (SELECT o_orderkey, o_orderdate + to_days(9000) AS ats FROM orders)""",
    "list_dates": """WITH p AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS dd,
          CASE WHEN o_orderkey % 3 = 2 THEN 2023 WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL
               WHEN make_date(2025, month(o_orderdate), day(o_orderdate)) > DATE '2025-03-07' THEN 2024 ELSE 2025 END AS y FROM orders)
        SELECT o_orderkey, CASE WHEN y IS NULL OR (m = 2 AND dd = 29 AND y <> 2024) THEN NULL ELSE strftime(make_date(y, m, dd), '%Y-%m-%d') END AS parsed FROM p""",
}
