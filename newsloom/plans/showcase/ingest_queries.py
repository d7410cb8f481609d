"""Identity, cascade and roll-ups (E rows)."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from newsloom.functions.text import event_key
from newsloom.operators import dedup, events, governance, similarity
from newsloom.operators.reach import earliest_in_reach
from newsloom.operators.scoring import analyze
from newsloom.plans.ingest import IngestConfig, ingest
from newsloom.plans.showcase.base import (
    ACTION_WORDS, ALIASES, AS_OF, AS_OF_SQL, CANDIDATE_CTE, COMPANY_CONTEXT, DOCS_CTE, EVENT_CTE, FALLBACKS, GATE_CTE, LABEL_WORDS, OVERSEAS_CONTEXT, PROJECT_LABELS,
    RELEVANCE as R, ROLLUP, docs, once, places, tagged_docs,
)
from newsloom.plans.showcase.tag_queries import _REL_CTE, GOV
from newsloom.rules import RelevanceRules, rule_list
from newsloom.session import checkpoint_root, cut_lineage
from newsloom.sources import sinks

num = lambda c: F.col(c).cast("bigint").alias(c)


def event_keys(spark, sf):
    df = tagged_docs(spark, sf)
    project = events.project_fingerprint(F.col("title"), F.col("country"), F.col("candidates"), F.col("labels"), PROJECT_LABELS)
    return df.select("doc_id", "event_key", project.alias("project_key"))


def _evidence(spark, sf):
    df = tagged_docs(spark, sf)
    return df.select("event_key", "source", F.when(F.col("source_type").isin("official", "policy"), "official").otherwise("media").alias("source_role"), "doc_id", "published_at", "title", "country", "candidates", "labels")


def event_rollup(spark, sf):
    out = events.event_rollup(_evidence(spark, sf), source="source")
    return out.select("event_key", num("source_count"), num("official_source_count"), "verification_status")


def project_rollup(spark, sf):
    df = cut_lineage(_evidence(spark, sf), "evidence").filter(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in PROJECT_LABELS])))
    df = df.withColumn("project_key", events.project_fingerprint(F.col("title"), F.col("country"), F.col("candidates"), F.col("labels"), PROJECT_LABELS))
    out = events.project_rollup(df, at="published_at", seq="doc_id")
    return out.select("project_key", "name", F.date_format("first_event_at", "yyyy-MM-dd").alias("first_event"), F.date_format("last_event_at", "yyyy-MM-dd").alias("last_event"), "event_count")


def title_near_duplicates(spark, sf):
    """Per document the earliest arrival with a similar title in reach (edit measure)."""
    d = similarity.title_ids(docs(spark, sf).select("doc_id", "title", "published_at"), "title").withColumn("since", F.coalesce("published_at", F.lit(AS_OF)) - F.make_dt_interval(F.lit(7)))
    d = cut_lineage(d, "titled")
    pairs = cut_lineage(similarity.similar_pairs(d.select("tid", "low").distinct(), "edit"), "pairs")
    # One row per title and date keeps a title with many copies small before the comparison.
    dates = d.filter("published_at is not null").groupBy(F.col("tid").alias("tid_l"), "published_at").agg(F.min("doc_id").alias("similar_to"))
    near = pairs.join(dates, "tid_l").select(F.col("tid_x").alias("tid"), "similar_to", F.col("published_at").alias("pub_l"), "score")
    found = earliest_in_reach(d, near, "doc_id", "tid", "since", "similar_to", "pub_l", ["score"])
    return found.select("doc_id", "similar_to", F.round("score", 6).alias("similarity"))


def _items(spark, sf):
    return tagged_docs(spark, sf).select(
        F.col("doc_id").alias("arrival_seq"), "url_key", "hash_key", "event_key", "title", "published_at", F.col("is_overseas").alias("eligible"), "confidence", "source", "source_type", "reliability_level",
    )


def ingest_cascade(spark, sf):
    out = dedup.ingest_cascade(_items(spark, sf), AS_OF, "edit")
    return out.select("arrival_seq", "outcome", "match_method", "leader_seq", F.round("match_score", 6).alias("match_score"))


def ingest_cascade_sequence(spark, sf):
    """The cascade with the matching-blocks ratio (no SQL equivalent; tested against a replay)."""
    out = dedup.ingest_cascade(_items(spark, sf), AS_OF, "sequence")
    return out.groupBy("outcome", "match_method").agg(F.count(F.lit(1)).alias("n"))


def url_groups(spark, sf):
    """Accepted addresses with their sightings and the last one."""
    d = _items(spark, sf).join(docs(spark, sf).select(F.col("doc_id").alias("arrival_seq"), "fetched_at"), "arrival_seq")
    out = dedup.exact_duplicates(d, "url_key", "arrival_seq", "fetched_at")
    return out.select("url_key", "leader_seq", "copies", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm").alias("last_seen"))


def _attached(spark, sf):
    """Evidence rows: every document attached to the first document of its content or month and source pair."""
    d = docs(spark, sf)
    return d.select(
        (F.col("doc_id") - F.col("doc_id") % 7).alias("article_id"), F.col("doc_id").alias("arrival_seq"), F.concat(F.lit("u/"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("url"), F.col("source").alias("source_name"),
        "source_type", F.col("source_type").isin("official", "procurement", "policy").alias("first_party"),
    )


def source_attachment(spark, sf):
    return dedup.attach_sources(_attached(spark, sf)).select("article_id", "url", "arrival_seq", "source_name")


def primary_promotion(spark, sf):
    a = docs(spark, sf).filter("doc_id % 7 = 0").select(
        F.col("doc_id").alias("article_id"), F.col("source").alias("source_name"), "source_type", "reliability_level", F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source_type").isin("official", "policy").alias("is_primary_source"), F.lit("unverified").alias("verification_status"),
    )
    e = _attached(spark, sf).filter("arrival_seq <> article_id")
    return dedup.promote_primary(a, e)


def duplicate_ledger(spark, sf):
    d = docs(spark, sf)
    o = d.select(F.col("doc_id").alias("arrival_seq"), F.md5(F.lower("title")).alias("url"), F.when(F.col("doc_id") % 3 == 0, "new").otherwise("duplicate").alias("outcome"),
                 F.floor(F.col("doc_id") / 3).alias("leader_seq"), F.lit("content_hash").alias("match_method"), F.lit(1.0).alias("match_score"))
    return dedup.duplicate_ledger(o, "url").select("url", "leader_seq", "match_method", "match_score")


def analysis_keys(spark, sf):
    a = analyze(docs(spark, sf), R, "title", "text", "source_type", "reliability_level")
    return a.select("doc_id", events.analysis_fingerprint(a).alias("fingerprint"))


def business_activities(spark, sf):
    a = analyze(docs(spark, sf), R, "title", "text", "source_type", "reliability_level")
    a = cut_lineage(a.select("doc_id", "source", "published_at", "entity_id", "project_name", "event_types", "relevance_score", "involved_leaders", "external_parties", "industry_tags"), "articles").withColumn("arrival_seq", F.col("doc_id"))
    rows = events.business_activities(a, (("signing", "signing"), ("state exchange", "government_exchange"), ("executive meeting", "executive_meeting"), ("planning", "project_advancement")), "entity_id", "source", "published_at")
    fresh = events.insert_if_absent(None, rows.withColumn("event_key", event_key(F.col("entity_id"), F.col("person_name"), F.col("activity_type"), F.col("source"))).withColumn("arrival_seq", F.col("doc_id") * 1000 + F.length("person_name")).dropDuplicates(["doc_id", "person_name"]))
    return fresh.select("event_key", "doc_id", "person_name", "activity_type", "appointment_type")


def org_event_keys(spark, sf):
    d = tagged_docs(spark, sf)
    d = d.withColumn("change", governance.org_change(F.col("text"), GOV)).filter("change is not null")
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("date-unverified"))
    d = d.withColumns({"org_key": event_key(F.col("source"), F.col("change"), day), "arrival_seq": F.col("doc_id")})
    return events.insert_if_absent(None, d, "org_key").select("org_key", "doc_id", "change")


def article_upsert(spark, sf):
    """Stored articles after changes that move some of them to another month."""
    path = f"{checkpoint_root(spark)}/newsloom/articles-{uuid.uuid4().hex}"
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "title", "published_at", F.col("doc_id").alias("arrival_seq"))
    sinks.write_keyed(d.filter("id % 9 <> 4"), path)
    moved = F.when(F.col("id") % 10 == 3, F.col("published_at") + F.make_dt_interval(F.lit(45))).when(F.col("id") % 10 != 7, F.col("published_at"))
    changes = d.filter("id % 10 in (3, 7) or id % 9 = 4").withColumns({"title": F.concat(F.lit("new "), "title"), "published_at": moved})
    older = changes.withColumns({"arrival_seq": F.col("arrival_seq") - 1, "title": F.lit("an older change")})
    sinks.upsert_keyed(spark, path, changes.unionByName(older))
    return sinks.read_keyed(spark, path).select("id", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"), "pub_month")


def _config():
    return IngestConfig(
        gazetteer=None, aliases=ALIASES, company_context=COMPANY_CONTEXT, overseas_context=OVERSEAS_CONTEXT, labels=rule_list(LABEL_WORDS), project_labels=PROJECT_LABELS,
        actions=rule_list(ACTION_WORDS), relevance=RelevanceRules(), label_fallbacks=FALLBACKS, label_rollup=ROLLUP, own_types=("official", "procurement"), official_types=("official", "policy"), measure="edit",
    )


def _landed(spark, sf):
    """Documents as landed items, and their sources."""
    d = docs(spark, sf)
    items = d.select(F.col("doc_id").alias("arrival_seq"), F.col("source").alias("source_name"), "title", "url", "published_at", F.col("text").alias("excerpt"), F.col("lang").alias("language"), F.lit(False).alias("link_only"))
    none = F.array().cast("array<string>")
    sources = d.select(F.col("source").alias("source_name"), "source_type", "reliability_level").distinct().withColumns(
        {"source_tags": none, "country_focus": none, "region_focus": none, "industry_focus": none, "entity_id": F.lit(None).cast("string")}
    )
    return items, sources


def _ingested(spark, sf):
    """All tables of one ingest of the documents."""
    items, sources = _landed(spark, sf)
    return once(spark, sf, "ingest", lambda: ingest(items, sources, replace(_config(), gazetteer=places(spark, sf)), AS_OF))


def ingest_articles(spark, sf):
    a = _ingested(spark, sf)["articles"]
    return a.select("article_id", "event_key", "project_key", num("cross_source_count"))


def ingest_evidence(spark, sf):
    return _ingested(spark, sf)["evidence"].select("article_id", "url", "arrival_seq", "source_name")


def ingest_events(spark, sf):
    e = _ingested(spark, sf)["events"]
    return e.select("event_key", num("source_count"), num("official_source_count"), "verification_status")


def ingest_projects(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    p = _ingested(spark, sf)["projects"]
    return p.select("project_key", "name", day("first_event_at").alias("first_event"), day("last_event_at").alias("last_event"), "event_count")


def ingest_two_batches(spark, sf):
    """The documents in two batches, the second over what the first one stored: the outcomes of a single one."""
    items, sources = _landed(spark, sf)
    config = replace(_config(), gazetteer=places(spark, sf))
    middle = items.agg(F.floor(F.avg("arrival_seq"))).first()[0]
    first = ingest(items.filter(F.col("arrival_seq") <= middle), sources, config, AS_OF)
    second = ingest(items.filter(F.col("arrival_seq") > middle), sources, config, AS_OF, first)
    out = first["outcomes"].unionByName(second["outcomes"])
    return out.select("arrival_seq", "outcome", "match_method", "leader_seq", F.round("match_score", 6).alias("match_score"))


QUERIES = {
    "article_upsert": article_upsert, "ingest_articles": ingest_articles, "ingest_evidence": ingest_evidence, "ingest_events": ingest_events, "ingest_projects": ingest_projects, "ingest_two_batches": ingest_two_batches,
    "event_key": event_keys, "event_rollup": event_rollup, "project_rollup": project_rollup, "title_near_duplicates": title_near_duplicates, "ingest_cascade": ingest_cascade,
    "ingest_cascade_sequence": ingest_cascade_sequence, "url_groups": url_groups, "source_attachment": source_attachment, "primary_promotion": primary_promotion,
    "duplicate_ledger": duplicate_ledger, "analysis_fingerprint": analysis_keys, "business_activities": business_activities, "org_event_keys": org_event_keys,
}

_E = f"WITH {DOCS_CTE}, {GATE_CTE}, {CANDIDATE_CTE}, {EVENT_CTE}"
_ER = _E.replace("WITH ", "WITH RECURSIVE ", 1)
# DuckDB measures bytes, Spark characters: accented letters become capitals, which lower text never holds.
_ASCII = lambda x: f"translate({x}, 'éèêçßüöäñóáíú', 'ABCDEFGHIJKLM')"
_SIM = lambda a, b: f"1 - levenshtein({_ASCII(a)}, {_ASCII(b)}) / greatest(length({a}), length({b}), 1)"
_ATT = """t AS (SELECT doc_id - doc_id % 7 AS article_id, doc_id AS arrival_seq, 'u/' || (doc_id - doc_id % 3) AS url, source AS source_name, source_type, source_type IN ('official', 'procurement', 'policy') AS first_party FROM d)"""
_OCASE = "CASE WHEN contains(sq, 'thonea') THEN 'merged' WHEN contains(sq, 'estion') OR contains(sq, 'ungen') THEN 'renamed' WHEN contains(sq, 'eation') THEN 'established' WHEN contains(text, 'ndtion') AND contains(text, 'tion') THEN 'dissolved' WHEN contains(text, 'oument') AND contains(text, 'tion') THEN 'split' END"
_JL = lambda c: f"'[' || array_to_string(list_transform(list_sort({c}), lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || ']'"
_JS = lambda c: f"CAST(to_json(coalesce({c}, '')) AS VARCHAR)"

ORACLE = {
    "event_key": f"{_E} SELECT doc_id, event_key, project_key FROM e",
    "event_rollup": f"""{_E}, r AS (SELECT event_key, count(DISTINCT source) AS source_count, count(DISTINCT CASE WHEN source_type IN ('official', 'policy') THEN source END) AS official_source_count FROM e GROUP BY 1)
        SELECT *, CASE WHEN source_count >= 2 AND official_source_count > 0 THEN 'cross_verified' WHEN official_source_count > 0 THEN 'source_verified' ELSE 'unverified' END AS verification_status FROM r""",
    "project_rollup": f"""{_E} SELECT project_key, arg_min(title, doc_id) AS name, (list(strftime(published_at, '%Y-%m-%d') ORDER BY doc_id))[1] AS first_event, strftime(max(published_at), '%Y-%m-%d') AS last_event, count(*) AS event_count
        FROM e WHERE ptypes <> '' GROUP BY 1""",
    "title_near_duplicates": f"""WITH {DOCS_CTE}, t AS (SELECT DISTINCT lower(title) AS low FROM d),
        p AS MATERIALIZED (SELECT a.low AS x, b.low AS l, {_SIM('a.low', 'b.low')} AS s FROM t a JOIN t b ON abs(length(a.low) - length(b.low)) <= 0.08 * greatest(length(a.low), length(b.low)) + 1e-9 WHERE {_SIM('a.low', 'b.low')} >= 0.92),
        h AS (SELECT i.doc_id, k.doc_id AS first_id, p.s FROM d i JOIN p ON p.x = lower(i.title) JOIN d k ON lower(k.title) = p.l AND k.doc_id < i.doc_id AND k.published_at >= coalesce(i.published_at, {AS_OF_SQL}) - INTERVAL 7 DAY)
        SELECT doc_id, min(first_id) AS similar_to, round(arg_min(s, first_id), 6) AS similarity FROM h GROUP BY 1""",
    "ingest_cascade": f"""{_ER},
        it AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS seq, url_key AS u, hash_key AS h, event_key AS ek, lower(title) AS low, published_at AS pub, coalesce(published_at, {AS_OF_SQL}) - INTERVAL 7 DAY AS since, is_overseas AS ok, confidence AS cf FROM e),
        prs AS MATERIALIZED (SELECT a.low AS x, b.low AS l, {_SIM('a.low', 'b.low')} AS s FROM (SELECT DISTINCT low FROM it) a JOIN (SELECT DISTINCT low FROM it) b
          ON abs(length(a.low) - length(b.low)) <= 0.08 * greatest(length(a.low), length(b.low)) + 1e-9 WHERE {_SIM('a.low', 'b.low')} >= 0.92),
        nb AS MATERIALIZED (SELECT i.seq, list(k.seq ORDER BY k.seq) AS near FROM it i JOIN prs ON prs.x = i.low JOIN it k ON k.low = prs.l AND k.seq < i.seq AND k.pub >= i.since GROUP BY 1),
        step AS (
          SELECT CAST(0 AS BIGINT) AS n, [NULL]::STRUCT(seq BIGINT, u VARCHAR, h VARCHAR, ek VARCHAR)[] AS led, NULL::BIGINT AS seq, NULL::INTEGER AS stage, NULL::BIGINT AS leader
          UNION ALL
          SELECT q.n, CASE WHEN q.stage = 0 THEN list_append(q.led, struct_pack(seq := q.seq, u := q.u, h := q.h, ek := q.ek)) ELSE q.led END, q.seq, q.stage, CASE q.stage WHEN 1 THEN mu WHEN 2 THEN mh WHEN 3 THEN mt WHEN 4 THEN me END
          FROM (SELECT *, CASE WHEN mu IS NOT NULL THEN 1 WHEN mh IS NOT NULL THEN 2 WHEN mt IS NOT NULL THEN 3 WHEN NOT ok THEN -1 WHEN me IS NOT NULL THEN 4 ELSE 0 END AS stage
            FROM (SELECT it.*, s.led, list_filter(s.led, lambda z: z.u = it.u)[1].seq AS mu, list_filter(s.led, lambda z: z.h = it.h)[1].seq AS mh,
                list_filter(s.led, lambda z: list_contains(coalesce(nb.near, []::BIGINT[]), z.seq))[1].seq AS mt, list_filter(s.led, lambda z: z.ek = it.ek)[1].seq AS me
              FROM step s JOIN it ON it.n = s.n + 1 LEFT JOIN nb ON nb.seq = it.seq)) q)
        SELECT s.seq AS arrival_seq, CASE s.stage WHEN 0 THEN 'new' WHEN 1 THEN 'updated' WHEN -1 THEN 'skipped' ELSE 'duplicate' END AS outcome,
          CASE s.stage WHEN 1 THEN 'canonical_url' WHEN 2 THEN 'content_hash' WHEN 3 THEN 'title_similarity' WHEN 4 THEN 'canonical_event' END AS match_method, s.leader AS leader_seq,
          round(CASE s.stage WHEN 2 THEN 1.0 WHEN 3 THEN (SELECT prs.s FROM prs, it a, it b WHERE a.seq = s.seq AND b.seq = s.leader AND prs.x = a.low AND prs.l = b.low) WHEN 4 THEN greatest(0.65, (SELECT cf FROM it b WHERE b.seq = s.leader)) END, 6) AS match_score
        FROM step s WHERE s.n > 0""",
    "url_groups": f"""WITH {DOCS_CTE} SELECT url_key, min(doc_id) AS leader_seq, count(*) AS copies, strftime(max(fetched_at), '%Y-%m-%d %H:%M') AS last_seen FROM d GROUP BY 1""",
    "source_attachment": f"WITH {DOCS_CTE}, {_ATT} SELECT article_id, url, min(arrival_seq) AS arrival_seq, arg_min(source_name, arrival_seq) AS source_name FROM t GROUP BY 1, 2",
    "primary_promotion": f"""WITH {DOCS_CTE}, {_ATT}, f AS (SELECT article_id, arg_min(struct_pack(s := source_name, y := source_type, u := url), arrival_seq) AS v FROM t WHERE first_party AND arrival_seq <> article_id GROUP BY 1),
        a AS (SELECT d.*, v, v IS NOT NULL AND NOT (reliability_level = 'high' AND source_type IN ('official', 'policy')) AS take FROM d LEFT JOIN f ON f.article_id = d.doc_id WHERE d.doc_id % 7 = 0)
        SELECT doc_id AS article_id, CASE WHEN take THEN v.s ELSE source END AS source_name, CASE WHEN take THEN v.y ELSE source_type END AS source_type, CASE WHEN take THEN 'high' ELSE reliability_level END AS reliability_level,
          CASE WHEN take THEN v.u ELSE 'u/' || doc_id END AS url, take OR source_type IN ('official', 'policy') AS is_primary_source, CASE WHEN take THEN 'source_verified' ELSE 'unverified' END AS verification_status FROM a""",
    "duplicate_ledger": f"WITH {DOCS_CTE} SELECT md5(lower(title)) AS url, min(doc_id) // 3 AS leader_seq, 'content_hash' AS match_method, 1.0::DOUBLE AS match_score FROM d WHERE doc_id % 3 <> 0 GROUP BY 1",
    "analysis_fingerprint": f"""WITH {DOCS_CTE}, {_REL_CTE} SELECT doc_id, sha256('{{"country": ' || {_JS('country')} || ', "date": ' || {_JS("strftime(published_at, '%Y-%m-%d')")} || ', "entity": ' || {_JS('entity_id')} || ', "parties": ' || {_JL('parties')}
        || ', "project": ' || {_JS('project_name')} || ', "types": ' || {_JL('event_types')} || '}}') AS fingerprint FROM a""",
    "business_activities": f"""WITH {DOCS_CTE}, {_REL_CTE}, b AS (SELECT *, CASE WHEN list_contains(event_types, 'signing') THEN 'signing' WHEN list_contains(event_types, 'state exchange') THEN 'government_exchange'
          WHEN list_contains(event_types, 'executive meeting') THEN 'executive_meeting' WHEN list_contains(event_types, 'planning') THEN 'project_advancement' END AS act FROM a WHERE score >= 30),
        x AS (SELECT doc_id, act, unnest(list_transform(leaders, lambda p: p.name)) AS person, entity_id, source FROM b WHERE act IS NOT NULL),
        k AS (SELECT *, sha256(coalesce(entity_id, '') || '|' || person || '|' || act || '|' || source) AS event_key FROM x)
        SELECT event_key, min(doc_id) AS doc_id, arg_min(person, doc_id) AS person_name, arg_min(act, doc_id) AS activity_type, CASE WHEN arg_min(act, doc_id) = 'signing' THEN 'signing' ELSE 'meeting' END AS appointment_type FROM k GROUP BY 1""",
    "org_event_keys": f"""WITH {DOCS_CTE}, q AS (SELECT *, regexp_replace(text, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g') AS sq FROM d), r AS (SELECT *, {_OCASE} AS change FROM q),
        k AS (SELECT *, sha256(source || '|' || change || '|' || coalesce(strftime(published_at, '%Y-%m-%d'), 'date-unverified')) AS org_key FROM r WHERE change IS NOT NULL)
        SELECT org_key, min(doc_id) AS doc_id, arg_min(change, doc_id) AS change FROM k GROUP BY 1""",
}

# The full ingest digests title and excerpt together; all else is the cascade above and what it feeds.
_OUT = ORACLE["ingest_cascade"].replace("regexp_replace(text, '[^\\p{L}\\p{N}_]+'", "regexp_replace(title || text, '[^\\p{L}\\p{N}_]+'")
_FED = f"""{_E}, o AS MATERIALIZED ({_OUT}),
    att AS (SELECT coalesce(leader_seq, arrival_seq) AS article_id, arrival_seq, source AS source_name, source_type IN ('official', 'policy') AS official,
        'HTTPS://News.Example.org//item/' || (CASE WHEN doc_id % 11 = 5 THEN doc_id - 4 ELSE doc_id END) || '/?utm_source=' || source || '#top' AS url FROM o JOIN d ON doc_id = arrival_seq WHERE outcome <> 'skipped'),
    ev AS (SELECT article_id, url, min(arrival_seq) AS arrival_seq, arg_min(source_name, arrival_seq) AS source_name, arg_min(official, arrival_seq) AS official FROM att GROUP BY 1, 2),
    lk AS (SELECT att.article_id, att.source_name, arg_min(ev.official, att.arrival_seq) AS official FROM att JOIN ev ON ev.article_id = att.article_id AND ev.url = att.url GROUP BY 1, 2),
    new AS (SELECT e.* FROM e JOIN o ON doc_id = arrival_seq WHERE outcome = 'new')"""
ORACLE |= {
    "article_upsert": f"""WITH {DOCS_CTE}, x AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 IN (3, 7) OR doc_id % 9 = 4 THEN 'new ' || title ELSE title END AS title,
          CASE WHEN doc_id % 10 = 3 THEN published_at + INTERVAL 45 DAY WHEN doc_id % 10 = 7 THEN NULL ELSE published_at END AS pub FROM d)
        SELECT id, title, strftime(pub, '%Y-%m-%d') AS published_at, coalesce(strftime(pub, '%Y-%m'), 'undated') AS pub_month FROM x""",
    "ingest_two_batches": _OUT,
    "ingest_evidence": f"{_FED} SELECT article_id, url, arrival_seq, source_name FROM ev",
    "ingest_articles": f"""{_FED}, n AS (SELECT article_id, count(DISTINCT source_name) AS cross_source_count FROM ev GROUP BY 1)
        SELECT article_id, event_key, CASE WHEN ptypes <> '' THEN project_key END AS project_key, cross_source_count FROM new JOIN n ON article_id = doc_id""",
    "ingest_events": f"""{_FED}, r AS (SELECT event_key, count(DISTINCT lk.source_name) AS source_count, count(DISTINCT CASE WHEN lk.official THEN lk.source_name END) AS official_source_count FROM lk JOIN new ON doc_id = article_id GROUP BY 1)
        SELECT event_key, source_count, official_source_count, CASE WHEN source_count >= 2 AND official_source_count > 0 THEN 'cross_verified' WHEN official_source_count > 0 THEN 'source_verified' ELSE 'unverified' END AS verification_status
        FROM new JOIN r USING (event_key)""",
    "ingest_projects": f"""{_FED} SELECT project_key, arg_min(title, doc_id) AS name, (list(strftime(published_at, '%Y-%m-%d') ORDER BY doc_id))[1] AS first_event, strftime(max(published_at), '%Y-%m-%d') AS last_event, count(*) AS event_count
        FROM new WHERE ptypes <> '' GROUP BY 1""",
}
