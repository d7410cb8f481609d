"""Source catalogue: load, upsert, capability report, classification of stored responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import html as H

# Phrases that decide a capability, and the archive depth for a year.
CAPTCHA = ("captcha", "recaptcha", "hcaptcha", "验证您是真人")
PAYWALL = ("subscribe to continue", "sign in to continue", "paywall")
YEAR_ENTRIES, MAX_LINKS, LINK_CHARS = 100, 200, 8
REPORT_TYPES = ("crawlable", "one_year_backfill")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The source catalogue as one JSON list file."""
    return spark.read.schema(schemas.SOURCES).option("multiLine", True).json(path)


def upsert_catalog(stored: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """Incoming values win except the fields operators edit.

    * ``enabled`` and ``schedule_minutes`` keep the stored value, but a source that was pending
      or disabled and now has an active reader takes the incoming ``enabled``.
    * a source paused after five failures stays paused.
    * backfill settings follow the catalogue only before a backfill has started.
    """
    key = "source_name"
    s = stored.select(*[F.col(c).alias(f"s_{c}") if c != key else F.col(c) for c in stored.columns]).withColumn("_s", F.lit(True))
    i = incoming.select(*[F.col(c).alias(f"i_{c}") if c != key else F.col(c) for c in incoming.columns]).withColumn("_i", F.lit(True))
    j = s.join(i, key, "full_outer")
    only_stored, is_new = F.col("_i").isNull(), F.col("_s").isNull()
    paused = (F.col("s_adapter_status") == "paused") & (F.col("s_consecutive_failures") >= 5) & (F.col("i_adapter_status") == "active")
    adapted = F.col("s_adapter_status").isin("pending_adapter", "disabled") & (F.col("i_adapter_status") == "active")
    status = F.when(F.coalesce(paused, F.lit(False)), "paused").otherwise(F.col("i_adapter_status"))
    enabled = F.when(is_new | F.coalesce(adapted, F.lit(False)), F.col("i_enabled")).otherwise(F.col("s_enabled"))
    fresh = F.col("s_backfill_status") == "not_started"
    now = F.lit(as_of).cast("timestamp")
    due = F.coalesce("s_next_run_at", F.when((status == "active") & (is_new | enabled), now))
    special = {
        "adapter_status": status,
        "enabled": enabled,
        "schedule_minutes": F.coalesce("s_schedule_minutes", "i_schedule_minutes"),
        "backfill_enabled": F.when(is_new | fresh, F.col("i_backfill_enabled")).otherwise(F.col("s_backfill_enabled")),
        "backfill_status": F.coalesce("s_backfill_status", "i_backfill_status"),
        "consecutive_failures": F.coalesce("s_consecutive_failures", F.lit(0)),
        "next_run_at": F.when(is_new | status.isin("active", "paused"), due),
    }
    cols = []
    for c in stored.columns:
        if c == key:
            cols.append(F.col(c))
        else:
            cols.append(F.when(only_stored, F.col(f"s_{c}")).otherwise(special.get(c, F.col(f"i_{c}"))).alias(c))
    return j.select(*cols)


def classify_responses(responses: DataFrame) -> DataFrame:
    """Capability of each stored response, by precedence.

    ``responses``: source_name, robots_allowed, http_status, content_type, body, feed_body,
    sitemap_body (the last two when a feed link or sitemap was landed too).
    """
    low = F.lower(F.coalesce("body", F.lit("")))
    has = lambda words: F.greatest(*[F.instr(low, w) for w in words]) > 0
    entries = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)<(?:item|entry)\b"), F.lit(0)))
    is_feed = F.coalesce(F.lower("content_type").contains("xml"), F.lit(False)) | F.substring(low, 1, 1000).contains("<rss") | F.substring(low, 1, 1000).contains("<feed")
    feed_link = r"""<link\b(?=[^>]*\bhref\s*=\s*["'][^"'>])[^>]*type\s*=\s*["'][^"']*(?:rss|atom)"""
    advertised = low.rlike(feed_link)
    lone_test = F.coalesce(F.col("feed_body").rlike(r"(?is)<title[^>]*>\s*(?:<!\[CDATA\[)?\s*test\s*(?:\]\]>)?\s*</title>"), F.lit(False))
    feed_n = F.when((entries(F.col("feed_body")) == 1) & lone_test, 0).otherwise(entries(F.col("feed_body")))
    site_low = F.lower(F.substring(F.coalesce("sitemap_body", F.lit("")), 1, 2000))
    is_site = site_low.contains("<urlset") | site_low.contains("<sitemapindex")
    locs = F.size(F.regexp_extract_all(F.coalesce("sitemap_body", F.lit("")), F.lit("(?i)<loc>"), F.lit(0)))
    links = F.filter(
        F.regexp_extract_all(H.drop_blocks(F.coalesce("body", F.lit("")), ("script", "style")), F.lit(r"(?is)<a\b[^>]*href[^>]*>(.*?)</a\s*>"), F.lit(1)),
        lambda a: F.char_length(H.plain_text(a)) >= LINK_CHARS,
    )
    n_links = F.size(links)
    scripted = low.rlike(r"<script[^>]+src=")
    status = (
        F.when(~F.coalesce("robots_allowed", F.lit(True)), "robots_blocked")
        .when(F.col("http_status") == 429, "rate_limited")
        .when(F.col("http_status").isin(401, 403), "login_required")
        .when(F.col("http_status") >= 400, "parsing_failed")
        .when(has(CAPTCHA), "javascript_required")
        .when(has(PAYWALL), "paywalled")
        .when(is_feed | advertised, "rss_available")
        .when(is_site, "sitemap_available")
        .when(n_links > 0, "reachable_no_content")
        .when(scripted, "javascript_required")
        .otherwise("reachable_no_content")
    )
    out = responses.withColumn("status", status)
    s = F.col("status")
    count = (
        F.when(s == "rss_available", F.when(is_feed, entries(F.col("body"))).otherwise(feed_n))
        .when(s == "sitemap_available", locs)
        .when(s == "reachable_no_content", F.least(n_links, F.lit(MAX_LINKS)))
        .otherwise(0)
    )
    out = out.withColumn("test_count", count)
    older = low.rlike(r"(archive|page=|pagination|下一页|older)")
    year = (
        F.when((s == "rss_available") & is_feed, F.col("test_count") >= YEAR_ENTRIES)
        .when(s == "sitemap_available", F.col("test_count") >= YEAR_ENTRIES)
        .when((s == "reachable_no_content") & (F.col("test_count") > 0), older)
        .otherwise(False)
    )
    return out.withColumns({"crawlable": s.isin("rss_available", "sitemap_available") & (F.col("test_count") > 0), "one_year_backfill": year})


def capability_summary(checks: DataFrame) -> DataFrame:
    """Counts by status with crawlable and one-year capable sources."""
    return checks.groupBy("status").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("crawlable")).alias("crawlable"),
        F.count_if(F.col("one_year_backfill")).alias("one_year_backfill"),
    )


def capability_table(checks: DataFrame) -> DataFrame:
    """The report rows sorted by name."""
    return checks.select("source_name", "status", "http_status", "crawlable", "one_year_backfill", "test_count").orderBy(F.lower("source_name"), "source_name")
