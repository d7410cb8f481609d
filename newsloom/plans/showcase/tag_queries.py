"""Tagging and scoring (D rows, C10, G12)."""

import uuid

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import governance, tagging
from newsloom.operators.scoring import analyze, longest_alias, sales_metadata, score_band
from newsloom.plans.showcase.base import (
    ACCOUNT_WORDS, ACTION_WORDS, ALIASES, COMPANY_CONTEXT, OVERSEAS_CONTEXT, CANDIDATE_CTE, DOCS_CTE, GATE_CTE, LABEL_WORDS, POLICY_LABELS, PRODUCT_DEFAULT,
    PRODUCT_WORDS, PROJECT_LABELS, RELEVANCE as R, docs, labels_column, places, sql_any, sql_first, sql_list, sql_str, table,
    tagged_docs, with_candidates,
)
from newsloom.rules import read_rules, rule_labels, rule_list
from newsloom.session import checkpoint_root

join = lambda c, sep="|": F.array_join(c, sep)
num = lambda c: c.cast("bigint")
PROJECT_SQL = r"([^,.;\n]{3,50}(?:ntion|keit))"


def tag_gate(spark, sf):
    df = tagging.country_gate(docs(spark, sf), "text", places(spark, sf))
    return df.select("doc_id", "is_overseas", "country", "region", F.round("overseas_confidence", 2).alias("confidence"), join("overseas_evidence").alias("evidence"))


def account_hits(spark, sf):
    df = tagging.account_hits(
        docs(spark, sf), "text", ACCOUNT_WORDS, ambiguous=("thly", "ado"), context=("thing", "asci"), shared=("thonea", ("Alder", "Doria"))
    )
    return df.select("doc_id", join("accounts").alias("accounts"), num(F.size("matched_keywords")).alias("keywords"), F.round("account_confidence", 2).alias("confidence"))


def multi_label(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", join(labels_column(F.col("text"), F.col("source_type"))).alias("labels"))


def multi_label_words(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", join(tagging.intelligence_labels(F.col("text"), rule_list(LABEL_WORDS), match="word")).alias("labels"))


def alias_candidates(spark, sf):
    c = with_candidates(docs(spark, sf)).select("doc_id", F.posexplode("candidates").alias("rank", "c"))
    return c.select(
        "doc_id", num(F.col("rank")).alias("rank"), F.col("c.account").alias("account"), F.col("c.matched_entity").alias("matched_entity"),
        F.round("c.confidence", 2).alias("confidence"), F.col("c.needs_review").alias("needs_review"),
        F.array_join(F.transform("c.evidence", lambda e: e["alias"]), "|").alias("evidence"),
    )


def alias_table(spark, sf):
    """Account candidates when the aliases are a table."""
    rows = [(i, a.account, a.alias, a.strength, a.lower) for i, a in enumerate(ALIASES)]
    aliases = spark.createDataFrame(rows, "position int, account string, alias string, strength string, lower boolean")
    c = tagging.candidates_by_table(table(spark, sf, "documents"), "text", "doc_id", aliases, COMPANY_CONTEXT, OVERSEAS_CONTEXT)
    return c.select("doc_id", "account", "matched_entity", F.round("confidence", 2).alias("confidence"), "needs_review", join("evidence").alias("evidence"))


def article_confidence(spark, sf):
    """Confidence of the gate and of the best account together."""
    df = tagged_docs(spark, sf)
    return df.select("doc_id", F.round(tagging.article_confidence(F.col("overseas_confidence"), F.col("candidates")), 2).alias("confidence"))


def alias_evidence(spark, sf):
    """Every alias that speaks for some account of a document."""
    df = tagged_docs(spark, sf).filter(F.size("candidates") > 0)
    return df.select("doc_id", join(tagging.evidence_aliases(F.col("candidates"))).alias("aliases"))


def dictionary_matches(spark, sf):
    """Every benchmark word of seven letters or more that occurs inside a document."""
    words = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("label"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))).alias("term")
    )
    terms = words.groupBy("term").agg(F.min(F.col("label").cast("bigint")).cast("string").alias("label"))
    return tagging.match_terms(table(spark, sf, "documents"), "text", "doc_id", terms)


def rule_table_labels(spark, sf):
    """Labels of documents by rules that are stored, read and joined as a table."""
    rows = [("topics", i, i, label, t, None, None, False) for i, (label, terms) in enumerate(LABEL_WORDS) for t in terms]
    path = f"{checkpoint_root(spark)}/newsloom/rules-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schemas.RULES).write.json(path)
    found = rule_labels(table(spark, sf, "documents"), "text", "doc_id", read_rules(spark, path), "topics")
    return found.select("doc_id", "label", F.col("priority").cast("bigint").alias("priority"))


def first_action(spark, sf):
    d = docs(spark, sf)
    return d.select(
        "doc_id", tagging.first_label(F.col("text"), rule_list(ACTION_WORDS)).alias("action"),
        join(tagging.first_list(F.col("text"), PRODUCT_WORDS, PRODUCT_DEFAULT)).alias("products"),
    )


def policy_rows(spark, sf):
    df = tagged_docs(spark, sf)
    out = tagging.policy_dimensions(df, "text", "labels", POLICY_LABELS, ("einlich", "Eation"), {"tax_rate_change": "tax_policy", "foreign_ratio": "foreign_access"})
    return out.select("doc_id", join("policy_types").alias("policy_types"), "tax_type", "tax_rate_change", "foreign_ratio", join("affected_countries").alias("affected"))


def source_roles(spark, sf):
    d = docs(spark, sf)
    role = tagging.source_role(F.col("source_type"), F.col("source"), F.when(F.col("lang") == "fr", "zh").otherwise(F.col("lang")), ("official", "procurement", "policy"), "competitor")
    return d.groupBy(role.alias("role"), "source_type").agg(F.count(F.lit(1)).alias("n"))


def longest_aliases(spark, sf):
    d = docs(spark, sf)
    e, p = longest_alias(F.col("text"), list(R.entities)), longest_alias(F.col("text"), list(R.places))
    return d.select("doc_id", e["c1"].alias("entity_id"), p["c1"].alias("country"), p["c2"].alias("region"))


def _analyzed(spark, sf):
    return analyze(docs(spark, sf), R, "title", "text", "source_type", "reliability_level")


def relevance_facts(spark, sf):
    a = _analyzed(spark, sf)
    return a.select(
        "doc_id", join("external_parties").alias("parties"), join("involved_departments").alias("departments"),
        join(F.transform("involved_leaders", lambda p: F.concat(p["name"], F.lit(":"), p["title"], F.lit(":"), p["role_in_event"]))).alias("leaders"),
        join("event_types").alias("event_types"), "project_stage", "project_name", join("industry_tags").alias("industries"),
        join("product_tags").alias("products"), join("topic_tags").alias("topics"), "exclusion_reason",
    )


def relevance_score(spark, sf):
    a = _analyzed(spark, sf)
    parts = ("score_project", "score_relationship", "score_fit", "score_decision", "score_reliability", "relevance_score")
    return a.select("doc_id", *[num(F.col(c)).alias(c) for c in parts], "requires_review")


def score_bands(spark, sf):
    a = _analyzed(spark, sf)
    return a.groupBy(score_band(F.col("relevance_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"), num(F.sum("relevance_score")).alias("points"))


def score_evidence(spark, sf):
    a = _analyzed(spark, sf)
    # Every row has all components.  Before a plain explode Spark tests their number first, for which it runs the analysis again.
    rows = a.select("doc_id", F.explode_outer("score_evidence").alias("component", "e"))
    return rows.select("doc_id", "component", num(F.col("e.score")).alias("score"), num(F.size("e.matched")).alias("n_matched"))


def relevance_texts(spark, sf):
    a = _analyzed(spark, sf)
    return a.select("doc_id", "signal", "opportunity", "recommended_contact", "recommended_action")


def sales_meta(spark, sf):
    df = tagged_docs(spark, sf)
    out = sales_metadata(df, "title", "text", "labels", ("antion", "retion"), PROJECT_LABELS, ("thing", "edtion"), "HOME", (r"of ([^,.]{2,50}?) (?:and|in) ", r"et ([^,.]{2,50}?) (?:de|la) "), "^(?:the )+", " on .*$")
    return out.select("doc_id", "is_relevant", "meta_country", "meta_region", num(F.col("overseas_rank")).alias("overseas_rank"), "counterparty")


GOV = governance.GovernanceRules(
    roles=("thing", "ment", "heit"),
    appointments=(("resignation", ("antion",)), ("transfer", ("hetion",)), ("appointment", ("retion", "ciónas"))),
    activities=(("inspection", ("hation",)), ("meeting", ("ortion", "queque"))),
    person_patterns=(r"(?:antion|retion) ([a-z]{2,4}) ", r"([a-z]{4}) (?:heit|thing|ment)"),
    surnames=("t", "o", "e", "d"), compound_surnames=("qu", "an"), name_stopwords=("the", "of"), name_shape="^[a-z]{2,4}$",
    org_changes=(("merged", ("thonea",)), ("renamed", ("estion", "ungen")), ("established", ("eation",))),
    org_fallbacks=(("dissolved", ("ndtion",)), ("split", ("oument",))), org_subjects=("tion",),
)


def org_changes(spark, sf):
    d = docs(spark, sf)
    change = governance.org_change(F.col("text"), GOV)
    d = d.withColumn("change", change)
    name = governance.new_entity_name(F.col("text"), F.col("change"), r"(thon[^,.\n]{0,40}?(?:eation|estion))", ("established", "renamed"))
    return d.select("doc_id", "change", name.alias("new_entity")).filter("change is not null")


def org_headlines(spark, sf):
    d = docs(spark, sf).withColumn("change", governance.org_change(F.col("text"), GOV)).filter("change is not null")
    title = governance.org_headline(
        F.when(F.col("doc_id") % 3 == 0, F.col("title")), F.col("change"), F.when(F.col("doc_id") % 5 == 1, F.col("source")),
        F.when(F.col("doc_id") % 10 == 1, F.col("lang")), F.col("text"), {"merged": "Merger", "renamed": "New name"},
        r"in ([^,.]{2,20}) the ([^,.]{4,60})", r"(?:estion|eation) ([^,.]{4,60})",
    )
    return d.select("doc_id", title.alias("headline"))


def feed_routes(spark, sf):
    df = tagged_docs(spark, sf)
    tags = F.when(F.substring("source", 4, 9).cast("int") < 8, F.array(F.lit("governed"))).otherwise(F.array(F.lit("plain")))
    hit = governance.org_change(F.col("text"), GOV, fallback=False).isNotNull()
    route = governance.feed_route(F.col("is_overseas"), tags, "governed", hit, F.col("source_type") == "media")
    lead = governance.effective_source(df.withColumn("link_only", F.col("doc_id") % 6 == 0), "manual")
    first = governance.first_party(F.col("source_type"), F.col("link_only"), ("official", "policy"))
    return lead.groupBy(route.alias("route"), "effective_type", "effective_reliability", first.alias("first_party")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "tag_gate": tag_gate, "account_hits": account_hits, "multi_label": multi_label, "multi_label_words": multi_label_words,
    "alias_candidates": alias_candidates, "alias_table": alias_table, "article_confidence": article_confidence, "alias_evidence": alias_evidence, "dictionary_matches": dictionary_matches, "rule_table_labels": rule_table_labels, "first_action": first_action,
    "policy_dimensions": policy_rows, "source_roles": source_roles, "longest_alias": longest_aliases, "relevance_facts": relevance_facts,
    "relevance_score": relevance_score, "score_bands": score_bands, "score_evidence": score_evidence, "relevance_texts": relevance_texts,
    "sales_metadata": sales_meta, "org_changes": org_changes, "org_headlines": org_headlines, "feed_routes": feed_routes,
}


def _longest(column, rows, i):
    ordered = sorted(rows, key=lambda r: len(r[0]), reverse=True)
    return "CASE " + " ".join(f"WHEN contains({column}, {sql_str(r[0])}) THEN {sql_str(r[i])}" for r in ordered) + " END"


_found = lambda c, terms: f"list_filter({sql_list(terms)}, lambda w0: contains({c}, w0))"
_P1, _P2 = (sql_str(p) for p in R.party_patterns)
_caught = lambda p: f"CASE WHEN regexp_matches(dt, {p}) THEN [trim(regexp_extract(dt, {p}, 1), ' .,')] ELSE []::VARCHAR[] END"
_LEADER = sql_str(R.leader_pattern)
_REL_CTE = f"""
a0 AS (SELECT *, trim(regexp_replace(title, '[\\s\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+', ' ', 'g'), ' -—|') AS dt FROM d),
a1 AS (SELECT *, trim(dt || chr(10) || text) AS t FROM a0),
a2 AS (
  SELECT *, {_longest('t', R.entities, 0)} AS entity_alias, {_longest('t', R.entities, 1)} AS entity_id, {_longest('t', R.places, 1)} AS country, {_longest('t', R.places, 2)} AS region,
    list_concat({_caught(_P1)}, {_caught(_P2)}) AS caught,
    list_filter(list_transform(list_filter(string_split_regex(text, '[.;\\n]'), lambda s: regexp_matches(s, {_LEADER})),
      lambda s: struct_pack(name := regexp_extract(s, {_LEADER}, 2), title := trim(regexp_extract(s, {_LEADER}, 1), '，、 '))),
      lambda p: NOT (contains(p.name, 'the') OR contains(p.name, 'of'))) AS lead_all,
    regexp_extract_all(t, {sql_str(R.unit_pattern)}) AS units,
    list_filter([{", ".join(f"CASE WHEN {sql_any('t', w)} THEN {sql_str(n)} END" for n, w in R.industries)}], lambda x: x IS NOT NULL) AS industries,
    {sql_first('t', R.stages)} AS stage,
    list_filter(list_transform(regexp_extract_all(t, {sql_str(PROJECT_SQL)}, 1), lambda v: trim(v)), lambda v: NOT contains(v, 'the ') AND NOT contains(v, 'der ') AND length(v) <= 50)[1] AS project_name,
    {sql_any('t', R.contract_terms)} AS contract, {_found('t', R.internal_terms)} AS internal, {_found('t', R.stale_terms)} AS stale,
    list_filter([{", ".join(f"CASE WHEN {sql_any('lower(t)' if fold else 't', [w.lower() for w in ws] if fold else ws)} THEN {sql_str(n)} END" for n, ws, fold in R.topics)}], lambda x: x IS NOT NULL) AS topics
  FROM a1
),
a3 AS (
  SELECT *,
    list_filter(list_concat(caught, list_concat(list_filter({_found('t', R.competitor_names)}, lambda n: len(list_filter(caught, lambda p: contains(p, n))) = 0), {_found('t', R.known_parties)})),
      lambda p: trim(p) <> '' AND NOT contains(p, chr(10)) AND NOT {sql_any('p', R.own_names)} AND length(p) <= 45) AS parties_raw,
    list_filter(lead_all, lambda p, i: list_position(list_transform(lead_all, lambda q: q.name), p.name) = i) AS leaders,
    list_filter({sql_list([n for n, _ in R.products])}, lambda i: list_contains(industries, i)) AS product_keys,
    {sql_any('t', R.project_terms)} OR project_name IS NOT NULL AS has_project
  FROM a2
),
a4 AS (
  SELECT *, list_filter(list_transform(parties_raw, lambda p: trim(p)), lambda p, i: list_position(list_transform(parties_raw, lambda q: trim(q)), p) = i) AS parties,
    list_filter(flatten(list_transform(list_filter(units, lambda u, i: list_position(units, u) = i), lambda u: list_transform({sql_list(R.departments)}, lambda x: u || x))), lambda n: contains(t, n)) AS departments,
    list_filter(flatten(list_transform(product_keys, lambda k: CASE k {" ".join(f"WHEN {sql_str(n)} THEN {sql_list(v)}" for n, v in R.products)} END)), lambda x: TRUE) AS products_raw
  FROM a3
),
a5 AS (
  SELECT *, country IS NOT NULL AND len(parties) > 0 AS foreign_party,
    list_filter(products_raw, lambda p, i: list_position(products_raw, p) = i) AS products,
    CASE WHEN len(internal) > 0 AND NOT (len(parties) > 0 OR stage IS NOT NULL OR {sql_any('t', R.business_terms)}) THEN 'internal: ' || array_to_string(internal, ', ')
         WHEN len(stale) > 0 AND NOT {sql_any('t', R.fresh_terms)} THEN 'retrospective: ' || array_to_string(stale, ', ') END AS exclusion
  FROM a4
),
a6 AS (
  SELECT *,
    list_filter([
      CASE WHEN foreign_party AND {sql_any('t', ('hation', 'oument'))} THEN CASE WHEN {sql_any('t', ('erer', 'elle'))} THEN 'state exchange' ELSE 'client visit' END END,
      CASE WHEN ({sql_any('t', ('hation',))} AND {sql_any('t', ('thing', 'ment'))}) OR {sql_any('t', ('thndly',))} THEN 'executive meeting' END,
      CASE WHEN {sql_any('t', ('antion', 'retion'))} THEN 'signing' END,
      CASE WHEN contains(upper(t), 'RETION') AND {sql_any('t', ('ortion', 'antion'))} THEN 'turnkey' END,
      CASE WHEN {sql_any('t', ('eation',))} THEN 'planning' END,
      CASE WHEN {sql_any('t', ('estion',))} AND {sql_any('t', ('tion', 'ung'))} THEN 'company formed' END], lambda x: x IS NOT NULL) AS event_types,
    CASE WHEN exclusion IS NOT NULL THEN CASE WHEN has_project THEN 3 ELSE 0 END
         WHEN has_project THEN least(30,
           CASE WHEN project_name IS NOT NULL OR (contract AND country IS NOT NULL) THEN 20 WHEN country IS NOT NULL AND {sql_any('t', R.need_terms)} THEN 15 ELSE 10 END
           + CASE WHEN contract OR coalesce(stage IN ('tender', 'design'), FALSE) THEN 10 WHEN stage IS NOT NULL THEN 8 ELSE 0 END) ELSE 0 END AS s_project,
    least(25, CASE WHEN len(parties) = 0 THEN 0 WHEN foreign_party AND {sql_any('t', R.authority_terms)} THEN 15 ELSE 10 END
           + CASE WHEN len(parties) > 0 AND {sql_any('t', R.partner_terms)} THEN 10 ELSE 0 END) AS s_rel,
    CASE WHEN exclusion IS NOT NULL THEN 0 WHEN list_contains(industries, 'data_center') OR len(industries) >= 3 THEN 20 WHEN len(industries) > 0 THEN 15 ELSE 0 END AS s_fit,
    least(15, CASE WHEN len(leaders) = 0 THEN 0 WHEN len(list_filter(leaders, lambda p: contains(p.title, 'ing'))) > 0 THEN 10 ELSE 5 END + CASE WHEN len(departments) > 0 THEN 5 ELSE 0 END) AS s_dec,
    CASE reliability_level WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END AS s_trust
  FROM a5
),
a AS (
  SELECT *, CASE WHEN exclusion IS NOT NULL THEN least(29, least(100, s_project + s_rel + s_fit + s_dec + s_trust)) ELSE least(100, s_project + s_rel + s_fit + s_dec + s_trust) END AS score,
    source_type = 'media' OR reliability_level = 'low' AS review,
    CASE WHEN len(departments) > 0 THEN array_to_string(departments, ', ') ELSE coalesce(entity_id, 'overseas or market department') END AS contact
  FROM a6
)"""
_REL = f"WITH {DOCS_CTE}, {_REL_CTE}"
_TAG = f"WITH {DOCS_CTE}, {GATE_CTE}"
_first_pct = r"regexp_extract_all(text, '\d+(?:\.\d+)?%')[1]"
_ORG1 = sql_first("squeezed", GOV.org_changes)
_ORG2 = "CASE " + " ".join(f"WHEN {sql_any('text', w)} AND {sql_any('text', GOV.org_subjects)} THEN {sql_str(n)}" for n, w in GOV.org_fallbacks) + " END"
_SQ = "regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', ' ', 'g')"
_clean = lambda x: f"trim(trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')), ' 。、，；')"
_WORD = lambda w: f"regexp_matches(' ' || low || ' ', '[^\\p{{L}}\\p{{N}}_](?:{'|'.join(w)})[^\\p{{L}}\\p{{N}}_]')"

_ACC = "list_filter([" + ", ".join(
    f"struct_pack(name := {sql_str(n)}, hits := list_filter({sql_list(w)}, lambda k: contains(text, k) AND NOT (list_contains(['thly', 'ado'], k) AND NOT ctx)))" for n, w in ACCOUNT_WORDS
) + "], lambda x: len(x.hits) > 0)"

ORACLE = {
    "tag_gate": f"""{_TAG} SELECT doc_id, is_overseas, country, region, gate_score::DOUBLE AS confidence, array_to_string(list_slice(evidence, 1, 8), '|') AS evidence FROM g""",
    "account_hits": f"""WITH b AS (SELECT doc_id, text, {sql_any('text', ('thing', 'asci'))} AS ctx FROM documents),
        x AS (SELECT doc_id, {_ACC} AS acc FROM b),
        y AS (SELECT doc_id, list_transform(acc, lambda p: p.name) AS names, list_distinct(flatten(list_transform(acc, lambda p: p.hits))) AS hits FROM x)
        SELECT doc_id, array_to_string(names, '|') AS accounts, CAST(len(hits) AS BIGINT) AS keywords,
          CASE WHEN list_contains(hits, 'thonea') AND list_has_all(names, ['Alder', 'Doria']) THEN 0.68 WHEN len(names) > 0 THEN least(0.97::DECIMAL(5,2), (0.62 + 0.09 * len(hits))::DECIMAL(5,2))::DOUBLE ELSE 0.35 END AS confidence FROM y""",
    "multi_label": f"{_TAG} SELECT doc_id, array_to_string(labels, '|') AS labels FROM g",
    "multi_label_words": f"""SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {_WORD(w)} THEN {sql_str(n)} END" for n, w in LABEL_WORDS)}], lambda x: x IS NOT NULL), '|') AS labels
        FROM (SELECT doc_id, lower(text) AS low FROM documents)""",
    "article_confidence": f"""WITH {DOCS_CTE}, {GATE_CTE}, {CANDIDATE_CTE}, k AS (SELECT doc_id, max(confidence) AS top FROM c GROUP BY 1)
        SELECT doc_id, round(least(0.98, greatest(gate_score::DOUBLE, coalesce(top, 0.35)::DOUBLE)), 2) AS confidence FROM g LEFT JOIN k USING (doc_id)""",
    "alias_evidence": f"""WITH {DOCS_CTE}, {CANDIDATE_CTE} SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS aliases
        FROM (SELECT doc_id, flatten(list(string_split(evidence, '|') ORDER BY confidence DESC, account)) AS l FROM c GROUP BY 1)""",
    "alias_table": f"""WITH {DOCS_CTE}, {CANDIDATE_CTE} SELECT doc_id, account, matched_entity, round(confidence, 2)::DOUBLE AS confidence, needs_review, evidence FROM c""",
    "alias_candidates": f"""WITH {DOCS_CTE}, {CANDIDATE_CTE}
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, account) - 1 AS rank, account, matched_entity, confidence::DOUBLE AS confidence, needs_review, evidence FROM c""",
    "rule_table_labels": "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({sql_str(label)}, {i}, {sql_str(t)})" for i, (label, terms) in enumerate(LABEL_WORDS) for t in terms)
        + ") AS v(label, priority, term)) SELECT DISTINCT doc_id, label, CAST(priority AS BIGINT) AS priority FROM documents JOIN r ON contains(lower(text), lower(term))",
    "dictionary_matches": """WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS term FROM benchmark),
        t AS (SELECT term, CAST(min(item_id) AS VARCHAR) AS label FROM w GROUP BY 1)
        SELECT doc_id, label, term FROM documents JOIN t ON contains(lower(text), term)""",
    "first_action": f"""SELECT doc_id, {sql_first('lower(text)', ACTION_WORDS)} AS action,
        coalesce(CASE {" ".join(f"WHEN {sql_any('text', k)} THEN {sql_str('|'.join(v))}" for k, v in PRODUCT_WORDS)} END, {sql_str('|'.join(PRODUCT_DEFAULT))}) AS products FROM documents""",
    "policy_dimensions": f"""{_TAG}, p AS (SELECT *, list_filter(labels, lambda x: list_contains({sql_list(POLICY_LABELS)}, x)) AS types FROM g)
        SELECT doc_id, array_to_string(types, '|') AS policy_types, CASE WHEN contains(low, 'einlich') THEN 'einlich' WHEN contains(low, 'eation') THEN 'Eation' END AS tax_type,
          CASE WHEN list_contains(types, 'tax_policy') THEN {_first_pct} END AS tax_rate_change, CASE WHEN list_contains(types, 'foreign_access') THEN {_first_pct} END AS foreign_ratio,
          coalesce(country, '') AS affected FROM p WHERE len(types) > 0""",
    "source_roles": f"""WITH {DOCS_CTE} SELECT CASE WHEN source_type IN ('official', 'procurement', 'policy') THEN 'official' WHEN source_type = 'competitor' THEN 'manual'
        WHEN lang = 'fr' THEN 'domestic_media' ELSE 'overseas_media' END AS role, source_type, count(*) AS n FROM d GROUP BY 1, 2""",
    "longest_alias": f"""SELECT doc_id, {_longest('text', R.entities, 1)} AS entity_id, {_longest('text', R.places, 1)} AS country, {_longest('text', R.places, 2)} AS region FROM documents""",
    "relevance_facts": f"""{_REL} SELECT doc_id, array_to_string(parties, '|') AS parties, array_to_string(departments, '|') AS departments,
        array_to_string(list_transform(leaders, lambda p: p.name || ':' || p.title || ':' || CASE WHEN contains(p.title, 'tion') THEN 'lead participant' ELSE 'participant' END), '|') AS leaders,
        array_to_string(event_types, '|') AS event_types, stage AS project_stage, project_name, array_to_string(industries, '|') AS industries,
        array_to_string(products, '|') AS products, array_to_string(topics, '|') AS topics, exclusion AS exclusion_reason FROM a""",
    "relevance_score": f"""{_REL} SELECT doc_id, CAST(s_project AS BIGINT) AS score_project, CAST(s_rel AS BIGINT) AS score_relationship, CAST(s_fit AS BIGINT) AS score_fit,
        CAST(s_dec AS BIGINT) AS score_decision, CAST(s_trust AS BIGINT) AS score_reliability, CAST(score AS BIGINT) AS relevance_score, review AS requires_review FROM a""",
    "score_bands": f"""{_REL} SELECT CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 30 THEN 'low' END AS band, count(*) AS n, CAST(sum(score) AS BIGINT) AS points FROM a GROUP BY 1""",
    "score_evidence": f"""{_REL} SELECT doc_id, unnest(['project_opportunity', 'customer_relationship', 'business_fit', 'decision_maker', 'source_reliability']) AS component,
        CAST(unnest([s_project, s_rel, s_fit, s_dec, s_trust]) AS BIGINT) AS score,
        CAST(unnest([(project_name IS NOT NULL)::INT + (stage IS NOT NULL)::INT + (country IS NOT NULL)::INT, len(parties), len(industries) + len(products), len(leaders) + len(departments), 2]) AS BIGINT) AS n_matched FROM a""",
    "relevance_texts": f"""{_REL} SELECT doc_id,
        substr(CASE WHEN foreign_party THEN parties[1] || ' and ' || coalesce(entity_alias, 'the monitored group') || ' discuss ' || coalesce(stage, 'related business') || '.'
          WHEN len(event_types) > 0 THEN coalesce(entity_alias, 'the monitored group') || ' reports ' || array_to_string(list_slice(event_types, 1, 2), ', ') || '.'
          ELSE coalesce(entity_alias, 'the monitored group') || ' published related information.' END || CASE WHEN review THEN ' Verify with an official source.' ELSE '' END, 1, 180) AS signal,
        substr(CASE WHEN len(products) > 0 THEN 'Possible demand: ' || array_to_string(list_slice(products, 1, 4), ', ') ELSE 'No product demand identified yet.' END, 1, 220) AS opportunity,
        contact AS recommended_contact,
        substr('Contact ' || contact || ' to confirm name, funding, design stage and procurement dates' || CASE WHEN country IS NOT NULL THEN '; inform the team in ' || country ELSE '' END || '.', 1, 260) AS recommended_action FROM a""",
    "sales_metadata": f"""{_TAG}, m AS (SELECT *, {sql_any('text', ('antion', 'retion'))} AS kw, {_SQ} AS squeezed, coalesce(country, CASE WHEN NOT is_overseas THEN 'HOME' END) AS mc FROM g),
        n AS (SELECT *, coalesce(region, CASE WHEN mc = 'HOME' THEN 'HOME' END) AS mr,
          regexp_extract(squeezed, 'of ([^,.]{{2,50}}?) (?:and|in) ', 1) AS r1, regexp_extract(squeezed, 'et ([^,.]{{2,50}}?) (?:de|la) ', 1) AS r2 FROM m),
        o AS (SELECT *, trim(regexp_replace(regexp_replace({_clean('r1')}, '^(?:the )+', ''), ' on .*$', '')) AS p1, trim(regexp_replace(regexp_replace({_clean('r2')}, '^(?:the )+', ''), ' on .*$', '')) AS p2 FROM n)
        SELECT doc_id, (kw OR list_has_any(labels, {sql_list(PROJECT_LABELS)})) AND NOT ({sql_any('title', ('thing', 'edtion'))} AND NOT kw) AS is_relevant, mc AS meta_country, mr AS meta_region,
          CAST(CASE WHEN is_overseas OR coalesce(mc <> 'HOME', FALSE) OR coalesce(mr <> 'HOME', FALSE) THEN 0 ELSE 1 END AS BIGINT) AS overseas_rank,
          CASE WHEN length(p1) BETWEEN 2 AND 40 THEN p1 WHEN length(p2) BETWEEN 2 AND 40 THEN p2 END AS counterparty FROM o""",
    "org_changes": f"""WITH q AS (SELECT doc_id, text, {_SQ} AS squeezed FROM documents), r AS (SELECT doc_id, text, coalesce({_ORG1}, {_ORG2}) AS change FROM q)
        SELECT doc_id, change, CASE WHEN change IN ('established', 'renamed') THEN nullif({_clean("regexp_extract(text, '(thon[^,.\\n]{0,40}?(?:eation|estion))', 1)")}, '') END AS new_entity FROM r WHERE change IS NOT NULL""",
    "org_headlines": f"""WITH {DOCS_CTE}, q AS (SELECT *, {_SQ} AS sq0, {_SQ} AS squeezed FROM d), r AS (SELECT *, trim(sq0) AS ev, coalesce({_ORG1}, {_ORG2}) AS change,
          CASE WHEN doc_id % 5 = 1 THEN source END AS before_name, CASE WHEN doc_id % 10 = 1 THEN lang END AS after_name FROM q),
        s AS (SELECT *, CASE change WHEN 'merged' THEN 'Merger' WHEN 'renamed' THEN 'New name' ELSE change END AS label FROM r WHERE change IS NOT NULL)
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND trim(title) <> '' THEN trim(title)
          WHEN before_name IS NOT NULL AND after_name IS NOT NULL AND before_name <> after_name THEN label || ': ' || before_name || ' → ' || after_name
          WHEN regexp_matches(ev, 'in ([^,.]{{2,20}}) the ([^,.]{{4,60}})') THEN label || ': ' || {_clean("regexp_extract(ev, 'in ([^,.]{2,20}) the ([^,.]{4,60})', 1) || regexp_extract(ev, 'in ([^,.]{2,20}) the ([^,.]{4,60})', 2)")}
          WHEN regexp_matches(ev, '(?:estion|eation) ([^,.]{{4,60}})') THEN label || ': ' || {_clean("regexp_extract(ev, '(?:estion|eation) ([^,.]{4,60})', 1)")}
          ELSE label || ': ' || coalesce(nullif({_clean("coalesce(after_name, before_name, substr(ev, 1, 32))")}, ''), 'organisation change to verify') END AS headline FROM s""",
    "feed_routes": f"""{_TAG}, q AS (SELECT *, {_SQ} AS squeezed FROM g)
        SELECT CASE WHEN is_overseas THEN 'overseas' WHEN CAST(substr(source, 4) AS INTEGER) < 8 AND ({_ORG1}) IS NOT NULL THEN 'governance' WHEN source_type = 'media' THEN 'manual_review' ELSE 'skipped' END AS route,
          CASE WHEN doc_id % 6 = 0 THEN 'manual' ELSE source_type END AS effective_type, CASE WHEN doc_id % 6 = 0 THEN 'low' ELSE reliability_level END AS effective_reliability,
          doc_id % 6 <> 0 AND source_type IN ('official', 'policy') AS first_party, count(*) AS n FROM q GROUP BY ALL""",
}
