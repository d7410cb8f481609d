"""Leadership, list filters, review states and side outputs."""

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import event_key
from newsloom.operators import changes, events, governance, reviews, search, tagging
from newsloom.plans.showcase.base import (
    ACTION_WORDS, AS_OF, CANDIDATE_CTE, DOCS_CTE, GATE_CTE, POLICY_LABELS, article_table, docs, sql_any, sql_first, sql_list, table, tagged_docs,
)
from newsloom.plans.showcase.ingest_queries import ORACLE as INGEST_ORACLE, _items
from newsloom.plans.showcase.page_queries import _VERS, _changed, _responses
from newsloom.plans.showcase.stream_queries import landed_in_batches
from newsloom.plans.showcase.tag_queries import GOV
from newsloom.rules import rule_list
from newsloom.session import checkpoint_root, cut_lineage
from newsloom.sources import catalog
from newsloom.streaming import jobs

num = lambda c: F.col(c).cast("bigint").alias(c)


def leadership(spark, sf):
    out = governance.leadership(docs(spark, sf), "text", GOV)
    return out.select("doc_id", "person_name", "appointment_type", "role_change", "title_before", "title_after", "leadership_confidence").filter("person_name is not null")


def leadership_events(spark, sf):
    """Stored personnel changes: one row per key, from its first article."""
    out = governance.leadership(docs(spark, sf), "text", GOV).withColumn("arrival_seq", F.col("doc_id"))
    out = cut_lineage(out.select("doc_id", "arrival_seq", "source", "published_at", "person_name", "appointment_type", "role_change"), "leadership").filter("role_change")
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("date-unverified"))
    rows = out.withColumn("event_key", event_key(F.col("source"), F.col("person_name"), F.col("appointment_type"), day))
    return events.insert_if_absent(None, rows).select("event_key", "doc_id", "person_name", "appointment_type")


def leadership_list(spark, sf):
    """Leadership rows filtered by kind and plausible name before the newest fifty are cut."""
    out = governance.leadership(docs(spark, sf), "text", GOV).select("doc_id", "person_name", "appointment_type", F.coalesce("published_at", "fetched_at").alias("shown_at"))
    out = cut_lineage(out, "leadership")
    out = governance.drop_implausible_people(search.equality_filters(out, appointment_type="appointment"), "person_name", GOV)
    return out.orderBy(F.desc("shown_at"), "doc_id").limit(50).select("doc_id", "person_name")


def leader_events(spark, sf):
    df = tagged_docs(spark, sf).withColumn("action", tagging.first_label(F.col("text"), rule_list(ACTION_WORDS)))
    out = governance.leader_event(df, "text", "labels", "action", r"(?:thing|ment) ([a-z]{2,4})(?= (?:to|de|la|is))", r"([a-z]{2,4}) (?:thing|ment)", r"([a-z]{2,20} (?:thing|ment))", "leader", ("meeting", "appointment"))
    return out.select("doc_id", "person_name", "person_title", "organization", "matched_entity", F.round("leader_confidence", 2).alias("confidence"))


def policy_country(spark, sf):
    df = article_table(spark, sf, "doc_id", "labels", "country")
    df = df.filter(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in POLICY_LABELS])))
    df = df.withColumns({"publishing_country": F.when(F.col("doc_id") % 2 == 0, F.col("country")), "affected_countries": F.when(F.col("country").isNotNull(), F.array("country")).otherwise(F.array().cast("array<string>"))})
    return search.policy_in_country(df, "NATION_3").select("doc_id")


def org_entities(spark, sf):
    """Organisation list: equality filters and a two-key sort, every row."""
    c = table(spark, sf, "customer").withColumns({"active": F.col("c_custkey") % 4 != 0, "level": F.col("c_mktsegment")})
    out = search.equality_filters(c, level="BUILDING", active=True, c_nationkey=None)
    return out.orderBy("c_nationkey", "c_name").select("c_custkey", "c_name")


def page_change_reviews(spark, sf):
    """Change records with the state of their latest review."""
    rec = changes.change_records(_changed(spark, sf), "text").select(F.concat_ws("-", F.col("url").cast("string"), F.col("captured_at").cast("string")).alias("change_id"), "url", "verification_status")
    acts = F.array(F.lit("approve"), F.lit("reject"), F.lit("needs_changes"))
    log = rec.filter("url % 2 = 0").select("change_id", F.get(acts, (F.col("url") % 3).cast("int")).alias("action"), F.col("url").alias("review_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    out = reviews.fold_reviews(rec, log, "change_id", reviews.CHANGE_STATES, "verification_status")
    return out.select("change_id", "verification_status")


def retained_versions(spark, sf):
    d = docs(spark, sf).select("doc_id", "fetched_at")
    return changes.retain(d, "fetched_at", F.lit(AS_OF)).select("doc_id")


def undated_split(spark, sf):
    dated, undated = jobs.undated_side_output(docs(spark, sf).select("doc_id", "published_at"), "published_at")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    return count(dated, "dated").unionByName(count(undated, "undated"))


def newest_per_source(spark, sf):
    """The newest ten dated documents of each source (limited before the shuffle)."""
    d = docs(spark, sf).select("doc_id", "source", "published_at").filter("published_at is not null")
    w = Window.partitionBy("source").orderBy(F.desc("published_at"), "doc_id")
    return d.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("source", num("rank"), "doc_id")


def capability_report(spark, sf):
    t = catalog.capability_table(catalog.classify_responses(_responses(spark, sf)))
    return t.filter("crawlable").select("source_name", "status", num("http_status"), num("test_count"))


def ingest_state(spark, sf):
    """Outcomes of the cascade fed by three micro-batches of tagged documents, state kept in Parquet."""
    root = os.path.join(checkpoint_root(spark), "newsloom-streams", f"ingest-{uuid.uuid4().hex}")
    landed_in_batches(spark, _items(spark, sf), "arrival_seq", root + "/in", lambda s: jobs.ingest_stream(s, root + "/state", root + "/_c", AS_OF, lambda b: b, "edit"))
    return spark.read.parquet(root + "/state")


def stream_ingest(spark, sf):
    """The cascade fed by a stream: the outcomes of a single batch."""
    out = ingest_state(spark, sf)
    return out.select("arrival_seq", "outcome", "match_method", "leader_seq", F.round("match_score", 6).alias("match_score"))


QUERIES = {
    "leadership": leadership, "leadership_events": leadership_events, "leadership_list": leadership_list, "leader_events": leader_events, "policy_country": policy_country, "org_entities": org_entities,
    "page_change_reviews": page_change_reviews, "retained_versions": retained_versions, "undated_split": undated_split, "newest_per_source": newest_per_source, "capability_report": capability_report,
    "stream_ingest": stream_ingest,
}

_C = "regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', ' ', 'g')"
_OKNAME = lambda n: f"(regexp_full_match({n}, '[a-z]{{2,4}}') AND NOT contains({n}, 'the') AND NOT contains({n}, 'of') AND (substr({n}, 1, 1) IN ('t', 'o', 'e', 'd') OR starts_with({n}, 'qu') OR starts_with({n}, 'an')))"
_P1, _P2 = "'(?:antion|retion) ([a-z]{2,4}) '", "'([a-z]{4}) (?:heit|thing|ment)'"
_LEAD = f"""l0 AS (SELECT *, {_C} AS c FROM d),
l1 AS (SELECT *, regexp_extract(c, {_P1}, 1) AS n1, regexp_extract(c, {_P2}, 1) AS n2, {sql_first('c', GOV.appointments)} AS ap, {sql_first('c', GOV.activities)} AS ac, {sql_any('c', GOV.roles)} AS has_role FROM l0),
l2 AS (SELECT *, CASE WHEN {_OKNAME('n1')} THEN n1 WHEN {_OKNAME('n2')} THEN n2 END AS person, coalesce(ap, ac) AS kind FROM l1),
l3 AS (SELECT *, '(thing|ment|heit).{{0,12}}' || person || '|' || person || '.{{0,12}}(thing|ment|heit)' AS near FROM l2 WHERE has_role AND kind IS NOT NULL AND person IS NOT NULL),
l4 AS (SELECT *, coalesce(nullif(regexp_extract(c, near, 1), ''), nullif(regexp_extract(c, near, 2), ''), nullif(regexp_extract(c, '(thing|ment|heit)', 1), '')) AS title0 FROM l3),
ld AS (SELECT *, ap IS NOT NULL AS role_change, CASE WHEN kind IN ('resignation', 'retirement', 'removal', 'transfer') THEN title0 END AS title_before,
  CASE WHEN ap IS NOT NULL AND kind NOT IN ('resignation', 'retirement', 'removal') THEN title0 END AS title_after FROM l4)"""

ORACLE = {
    "leadership": f"WITH {DOCS_CTE}, {_LEAD} SELECT doc_id, person AS person_name, kind AS appointment_type, role_change, title_before, title_after, CASE WHEN role_change THEN 0.86::DOUBLE ELSE 0.72::DOUBLE END AS leadership_confidence FROM ld",
    "leadership_events": f"""WITH {DOCS_CTE}, {_LEAD}, k AS (SELECT *, sha256(source || '|' || person || '|' || kind || '|' || coalesce(strftime(published_at, '%Y-%m-%d'), 'date-unverified')) AS event_key FROM ld WHERE role_change)
        SELECT event_key, min(doc_id) AS doc_id, arg_min(person, doc_id) AS person_name, arg_min(kind, doc_id) AS appointment_type FROM k GROUP BY 1""",
    "leadership_list": f"WITH {DOCS_CTE}, {_LEAD} SELECT doc_id, person AS person_name FROM ld WHERE kind = 'appointment' ORDER BY coalesce(published_at, fetched_at) DESC, doc_id LIMIT 50",
    "leader_events": f"""WITH {DOCS_CTE}, {GATE_CTE}, {CANDIDATE_CTE}, t AS (SELECT doc_id, arg_min(account, struct_pack(a := -confidence, b := account)) AS org, arg_min(matched_entity, struct_pack(a := -confidence, b := account)) AS ent, max(confidence)::DOUBLE AS cf FROM c GROUP BY 1),
        x AS (SELECT doc_id, text, {sql_first('low', ACTION_WORDS)} AS action FROM g WHERE list_contains(labels, 'leader'))
        SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?:thing|ment) ([a-z]{{2,4}}) (?:to|de|la|is)', 1), ''), nullif(regexp_extract(text, '([a-z]{{2,4}}) (?:thing|ment)', 1), '')) AS person_name,
          nullif(regexp_extract(text, '([a-z]{{2,20}} (?:thing|ment))', 1), '') AS person_title, org AS organization, ent AS matched_entity, round(coalesce(cf, 0.45), 2)::DOUBLE AS confidence
        FROM x LEFT JOIN t USING (doc_id) WHERE action IN ('meeting', 'appointment')""",
    "policy_country": f"WITH {DOCS_CTE}, {GATE_CTE} SELECT doc_id FROM g WHERE list_has_any(labels, {sql_list(POLICY_LABELS)}) AND country = 'NATION_3'",
    "org_entities": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 <> 0 ORDER BY c_nationkey, c_name",
    "page_change_reviews": f"""WITH {_VERS} SELECT url || '-' || captured_at AS change_id, CASE WHEN url % 2 = 0 THEN ['verified', 'rejected', 'pending_review'][url % 3 + 1] ELSE 'pending_review' END AS verification_status FROM chg WHERE ph IS NOT NULL""",
    "retained_versions": f"WITH {DOCS_CTE} SELECT doc_id FROM d WHERE fetched_at >= TIMESTAMP '2025-02-04' - INTERVAL 366 DAY",
    "undated_split": f"WITH {DOCS_CTE} SELECT CASE WHEN published_at IS NULL THEN 'undated' ELSE 'dated' END AS side, count(*) AS n FROM d GROUP BY 1",
    "newest_per_source": f"""WITH {DOCS_CTE}, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, doc_id) AS rank FROM d WHERE published_at IS NOT NULL) SELECT source, rank, doc_id FROM r WHERE rank <= 10""",
    "capability_report": """SELECT CAST(page_id AS VARCHAR) AS source_name, CASE WHEN page_id % 11 = 9 THEN 'sitemap_available' ELSE 'rss_available' END AS status, CAST(200 AS BIGINT) AS http_status,
        CAST(CASE WHEN page_id % 11 = 9 THEN page_id % 150 ELSE page_id % 130 END AS BIGINT) AS test_count FROM pages WHERE (page_id % 11 = 9 AND page_id % 150 > 0) OR (page_id % 11 IN (5, 10) AND page_id % 130 > 0)""",
    "stream_ingest": INGEST_ORACLE["ingest_cascade"],
}
