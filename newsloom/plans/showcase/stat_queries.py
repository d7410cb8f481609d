"""Statistics (G rows)."""

from datetime import timedelta

from pyspark.sql import functions as F

from newsloom.operators import stats
from newsloom.operators.events import distinct_sources
from newsloom.operators.tagging import first_label
from newsloom.plans.showcase.base import article_table, ACTION_WORDS, AS_OF, AS_OF_SQL, CANDIDATE_CTE, DOCS_CTE, EVENT_CTE, GATE_CTE, sql_any, sql_first, table, tagged_docs
from newsloom.rules import rule_list
from newsloom.session import cut_lineage

FAMILIES = {"rail_count": ["rail"], "power_count": ["grid", "storage"], "policy_count": ["tax_policy", "foreign_access"], "account_count": ["company", "leader"]}


def _articles(spark, sf):
    df = article_table(spark, sf, "doc_id", "event_key", "hash_key", "labels", "country", "region", "is_overseas", "published_at", "reliability_level")
    reviews = F.array(F.lit("pending"), F.lit("approved"), F.lit("rejected"), F.lit("needs_changes"))
    return df.withColumns({
        "canonical_event_id": F.when(F.col("doc_id") % 7 != 0, F.col("event_key")), "content_hash": F.col("hash_key"), "is_demo": F.col("doc_id") % 50 == 1,
        "review_status": F.get(reviews, (F.col("doc_id") % 4).cast("int")), "cross_source_count": F.col("doc_id") % 3, "intelligence_types": F.col("labels"),
    })


def events_per_region(spark, sf):
    return stats.distinct_events_by(stats.statistics_base(_articles(spark, sf), AS_OF), "region").select("region", "event_count")


def region_country_sets(spark, sf):
    return stats.distinct_events_by_sets(stats.statistics_base(_articles(spark, sf), AS_OF), ["country", "region"])


def sketched_regions(spark, sf):
    """Distinct events per region over 30 and 365 days: exact, and whether the sketches of the days come within four standard errors."""
    df = stats.statistics_base(_articles(spark, sf), AS_OF).filter("region is not null")
    sketches = cut_lineage(stats.daily_sketches(df, "published_at", ["region"]), "sketches")
    out = None
    for days in (30, 365):
        window = df.filter(F.to_date("published_at") >= F.to_date(F.lit(AS_OF - timedelta(days=days))))
        exact = stats.distinct_events_by(window, "region").select("region", "event_count")
        both = exact.join(stats.sketched_counts(sketches, AS_OF, days, ["region"]), "region")
        bound = F.greatest(F.lit(1.0), F.col("event_count") * 4 * 1.04 / 2 ** (stats.SKETCH_BITS / 2))
        rows = both.select(F.lit(days).alias("days"), "region", "event_count", (F.abs(F.col("estimate") - F.col("event_count")) <= bound).alias("within"))
        out = rows if out is None else out.unionByName(rows)
    return out


def dashboard(spark, sf):
    d = stats.dashboard(_articles(spark, sf), AS_OF, FAMILIES)
    return d.select(*[F.col(c).cast("bigint").alias(c) if not c.endswith("ratio") else F.col(c) for c in d.columns])


def opportunity_facets(spark, sf):
    df = tagged_docs(spark, sf).select("labels", first_label(F.col("text"), rule_list(ACTION_WORDS)).alias("event_type"), F.transform("candidates", lambda c: c["matched_entity"]).alias("entities"))
    df = cut_lineage(df, "articles").filter(F.array_contains("labels", "market_project"))
    return stats.facets(df, "event_type", {"intelligence_type": "labels", "matched_entity": "entities"})


def top_regions(spark, sf):
    sets = stats.distinct_events_by_sets(stats.statistics_base(_articles(spark, sf), AS_OF), ["country"])
    return stats.top_values(sets, 3).select("value", "event_count")


def source_counts(spark, sf):
    df = tagged_docs(spark, sf).select(F.col("event_key").alias("article_id"), "source")
    out = distinct_sources(df, "article_id", "source").filter("cross_source_count > 1")
    return out.select("article_id", F.col("cross_source_count").cast("bigint").alias("cross_source_count"))


def order_priority_sets(spark, sf):
    """Distinct customers per order status and priority in one pass."""
    o = table(spark, sf, "orders").withColumn("event_identity", F.col("o_custkey"))
    return stats.distinct_events_by_sets(o, ["o_orderstatus", "o_orderpriority"])


QUERIES = {
    "sketched_regions": sketched_regions, "events_per_region": events_per_region, "region_country_sets": region_country_sets, "dashboard": dashboard, "facets": opportunity_facets,
    "top_countries": top_regions, "cross_source_counts": source_counts, "customer_sets": order_priority_sets,
}

_E = f"WITH {DOCS_CTE}, {GATE_CTE}, {CANDIDATE_CTE}, {EVENT_CTE}"
_BASE = f"""{_E}, b AS (SELECT *, coalesce(CASE WHEN doc_id % 7 <> 0 THEN event_key END, hash_key) AS ident, ['pending', 'approved', 'rejected', 'needs_changes'][doc_id % 4 + 1] AS review
  FROM e WHERE is_overseas AND doc_id % 50 <> 1 AND doc_id % 4 <> 2 AND published_at >= {AS_OF_SQL} - INTERVAL 365 DAY)"""
_CNT = lambda cond: f"count(DISTINCT CASE WHEN {cond} THEN ident END)"
_ANY = lambda xs: "list_has_any(labels, [" + ", ".join(f"'{x}'" for x in xs) + "])"

ORACLE = {
    "sketched_regions": f"""{_BASE}, w AS (SELECT b.*, unnest([30, 365]) AS days FROM b WHERE region IS NOT NULL)
        SELECT days, region, count(DISTINCT ident) AS event_count, TRUE AS within FROM w WHERE published_at >= {AS_OF_SQL} - to_days(CAST(days AS INTEGER)) GROUP BY 1, 2""",
    "events_per_region": f"{_BASE} SELECT region, count(DISTINCT ident) AS event_count FROM b WHERE region IS NOT NULL GROUP BY 1",
    "region_country_sets": f"""{_BASE} SELECT CASE WHEN GROUPING(country) = 0 THEN 'country' ELSE 'region' END AS dimension, coalesce(country, region) AS value, count(DISTINCT ident) AS event_count
        FROM b WHERE country IS NOT NULL GROUP BY GROUPING SETS ((country), (region))""",
    "dashboard": f"""{_BASE}, q AS (SELECT count(DISTINCT ident) AS total, {_CNT(f"published_at >= {AS_OF_SQL} - INTERVAL 30 DAY")} AS recent_30, {_CNT("reliability_level = 'high'")} AS high_reliability,
          {_CNT("doc_id % 3 >= 2")} AS cross_source, {_CNT("review IN ('pending', 'needs_changes')")} AS pending_review, {", ".join(f"{_CNT(_ANY(v))} AS {k}" for k, v in FAMILIES.items())} FROM b)
        SELECT *, CASE WHEN total > 0 THEN round_even(high_reliability / total, 4) ELSE 0 END AS high_reliability_ratio, CASE WHEN total > 0 THEN round_even(cross_source / total, 4) ELSE 0 END AS cross_verified_ratio FROM q""",
    "facets": f"""{_E}, p AS (SELECT doc_id, text, labels FROM g WHERE list_contains(labels, 'market_project'))
        SELECT 'event_type' AS facet, coalesce({sql_first('lower(text)', ACTION_WORDS)}, 'unknown') AS value, count(*) AS n FROM p GROUP BY 1, 2
        UNION ALL SELECT 'intelligence_type', unnest(labels), count(*) FROM p GROUP BY 1, 2
        UNION ALL SELECT 'matched_entity', matched_entity, count(*) FROM c JOIN p USING (doc_id) GROUP BY 1, 2""",
    "top_countries": f"{_BASE} SELECT country AS value, count(DISTINCT ident) AS event_count FROM b WHERE country IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "cross_source_counts": f"{_E} SELECT event_key AS article_id, count(DISTINCT source) AS cross_source_count FROM e GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "customer_sets": """SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(DISTINCT o_custkey) AS event_count FROM orders GROUP BY 2
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(DISTINCT o_custkey) FROM orders GROUP BY 2""",
}
