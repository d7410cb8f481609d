"""Relevance analysis and score."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import bind, contains_any, display_title, evidence_excerpt, labels_where, squeeze, terms_found
from newsloom.operators.tagging import _strings, products_for
from newsloom.rules import EventRule, RelevanceRules

# Score points, caps and reliability points.
PROJECT_CAP, RELATION_CAP, DECISION_CAP, TOTAL_CAP, EXCLUDED_CAP = 30, 25, 15, 100, 29
RELIABILITY_POINTS = {"high": 10, "medium": 5, "low": 2}


def longest_alias(text: Column, table: list[tuple]) -> Column:
    """Entry of the longest alias present (table order breaks ties)."""
    ordered = sorted(table, key=lambda row: len(row[0]), reverse=True)
    names = [f"c{i}" for i in range(len(table[0]))] if table else ["c0"]
    kind = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    out = F.lit(None).cast(kind)
    for row in reversed(ordered):
        entry = F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)])
        out = F.when(text.contains(row[0]), entry).otherwise(out)
    return out


def external_parties(title: Column, text: Column, r: RelevanceRules) -> Column:
    """Parties caught by the title patterns, then dictionary names in the text."""
    empty = F.array().cast("array<string>")
    caught = F.array_compact(F.array(*[
        F.when(title.rlike(p), F.btrim(F.regexp_extract(title, p, 1), F.lit(r.party_strip))) for p in r.party_patterns
    ])) if r.party_patterns else empty
    named = F.filter(
        terms_found(text, r.competitor_names), lambda n: ~F.exists(caught, lambda p: F.contains(p, n))
    ) if r.competitor_names else empty
    every = F.concat(caught, named, terms_found(text, r.known_parties))
    plain = F.filter(
        every,
        lambda p: (F.trim(p) != "") & ~F.contains(p, F.lit("\n")) & ~contains_any(p, r.own_names) & (F.char_length(p) <= 45),
    )
    return F.array_distinct(F.transform(plain, lambda p: F.trim(p)))


def leaders(content: Column, r: RelevanceRules) -> Column:
    """Title, person and verb inside one segment; the first row of each name wins."""
    kind = "array<struct<name:string,title:string,role_in_event:string>>"
    if not r.leader_pattern:
        return F.array().cast(kind)
    hint = lambda s: contains_any(s, r.leader_terms) if r.leader_terms else F.lit(True)
    segments = F.filter(F.split(content, r.leader_split), lambda s: hint(s) & s.rlike(r.leader_pattern))
    found = F.transform(
        segments,
        lambda s: F.struct(
            F.regexp_extract(s, r.leader_pattern, 2).alias("name"),
            F.btrim(F.regexp_extract(s, r.leader_pattern, 1), F.lit("，、 ")).alias("title"),
        ),
    )
    ok = F.filter(found, lambda p: ~contains_any(p["name"], r.leader_reject))
    # Bound, so that the segments are searched once and not again for every name.
    first = lambda people, names: F.filter(people, lambda p, i: F.array_position(names, p["name"]) == i + 1)
    return F.transform(
        bind(ok, lambda people: bind(F.transform(people, lambda q: q["name"]), lambda names: first(people, names))),
        lambda p: F.struct(
            p["name"].alias("name"),
            p["title"].alias("title"),
            F.when(contains_any(p["title"], r.lead_roles), r.lead_role_label).otherwise(r.role_label).alias("role_in_event"),
        ),
    )


def departments(text: Column, r: RelevanceRules) -> Column:
    """Unit prefix joined to a department name, when that spelling is in the text."""
    empty = F.array().cast("array<string>")
    if not (r.unit_pattern and r.departments):
        return empty
    units = F.array_distinct(F.regexp_extract_all(text, F.lit(r.unit_pattern), F.lit(0)))
    names = F.flatten(F.transform(units, lambda u: F.transform(_strings(r.departments), lambda d: F.concat(u, d))))
    return F.array_distinct(F.filter(names, lambda n: F.contains(text, n)))


def event_types(text: Column, foreign_party: Column, rules: tuple[EventRule, ...]) -> Column:
    """Ordered labels; a rule may need several term groups or a foreign party."""
    if not rules:
        return F.array().cast("array<string>")
    values = []
    for rule in rules:
        body = F.upper(text) if rule.upper else text
        first = contains_any(body, rule.groups[0])
        rest = [contains_any(text, g) for g in rule.groups[1:]]
        gate = foreign_party if rule.foreign else F.lit(True)
        if rule.otherwise:
            strict = reduce(lambda a, b: a & b, rest, F.lit(True))
            values += [(rule.label, gate & first & strict), (rule.otherwise, gate & first & ~strict)]
        else:
            hit = reduce(lambda a, b: a & b, rest, first)
            if rule.or_terms:
                hit = hit | contains_any(text, rule.or_terms)
            values.append((rule.label, gate & hit))
    return F.array_distinct(labels_where(values))


def first_stage(text: Column, r: RelevanceRules) -> Column:
    """First stage rule with a hit."""
    if not r.stages:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(contains_any(text, terms), F.lit(label)) for label, terms in r.stages])


def project_name(text: Column, r: RelevanceRules) -> Column:
    """First pattern match without a generic word, at most 50 characters."""
    if not r.project_suffixes:
        return F.lit(None).cast("string")
    # A name never crosses a delimiter, so the costly pattern only sees pieces with a suffix.
    ends = "|".join(re.escape(s) for s in r.project_suffixes)
    pattern = rf"([^{r.project_delimiters}]{{3,50}}(?:{ends}))"
    pieces = F.filter(F.split(text, f"[{r.project_delimiters}]"), lambda s: contains_any(s, r.project_suffixes))
    found = F.transform(
        F.flatten(F.transform(pieces, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(1)))), lambda v: F.trim(v)
    )
    return F.get(
        F.filter(found, lambda v: ~contains_any(v, r.generic_project_terms) & (F.char_length(v) <= 50)), F.lit(0)
    )


def topic_tags(text: Column, r: RelevanceRules) -> Column:
    """Topic routes as (label, terms, ignore case)."""
    if not r.topics:
        return F.array().cast("array<string>")
    low = F.lower(text)
    return labels_where([
        (label, contains_any(low, [t.lower() for t in terms]) if fold else contains_any(text, terms)) for label, terms, fold in r.topics
    ])


def analyze(df: DataFrame, r: RelevanceRules, title: str, content: str, source_type: str, reliability: str) -> DataFrame:
    """The whole relevance analysis as column expressions in one stage.

    Adds the extracted facts, ``relevance_score`` (0-100), its component scores,
    ``score_evidence`` and the short text outputs.
    """
    has = lambda terms: contains_any(F.col("_text"), terms)
    out = (
        df.withColumn("display_title", display_title(F.col(title)))
        .withColumn("_text", F.trim(F.concat_ws("\n", "display_title", F.coalesce(F.col(content), F.lit("")))))
        .withColumn("_entity", longest_alias(F.col("_text"), list(r.entities)))
        .withColumn("_place", longest_alias(F.col("_text"), list(r.places)))
    )
    out = out.withColumns({
        "entity_alias": F.col("_entity.c0"),
        "entity_id": F.col("_entity.c1") if r.entities else F.lit(None).cast("string"),
        "country": F.col("_place.c1") if r.places else F.lit(None).cast("string"),
        "region": F.col("_place.c2") if r.places else F.lit(None).cast("string"),
        "external_parties": external_parties(F.col("display_title"), F.col("_text"), r),
        "involved_leaders": leaders(F.col(content), r),
        "involved_departments": departments(F.col("_text"), r),
        "industry_tags": labels_where([(n, has(t)) for n, t in r.industries]),
        "project_stage": first_stage(F.col("_text"), r),
        "project_name": project_name(F.col("_text"), r),
        "topic_tags": topic_tags(F.col("_text"), r),
    })
    has_party = F.size("external_parties") > 0
    has_country = F.col("country").isNotNull()
    out = out.withColumns({
        "product_tags": products_for(F.col("industry_tags"), r.products),
        "_foreign": has_country & has_party,
        "_contract": has(r.contract_terms),
        "_internal": terms_found(F.col("_text"), r.internal_terms),
        "_stale": terms_found(F.col("_text"), r.stale_terms),
        "_hasproject": has(r.project_terms) | F.col("project_name").isNotNull(),
    })
    out = out.withColumn("event_types", event_types(F.col("_text"), F.col("_foreign"), r.event_rules))
    # D20
    business = has_party | F.col("project_stage").isNotNull() | has(r.business_terms)
    out = out.withColumn(
        "exclusion_reason",
        F.when((F.size("_internal") > 0) & ~business, F.concat(F.lit("internal: "), F.array_join("_internal", ", ")))
        .when((F.size("_stale") > 0) & ~has(r.fresh_terms), F.concat(F.lit("retrospective: "), F.array_join("_stale", ", "))),
    )
    excluded = F.col("exclusion_reason").isNotNull()
    # D21
    base = (
        F.when(F.col("project_name").isNotNull() | (F.col("_contract") & has_country), 20)
        .when(has_country & has(r.need_terms), 15)
        .otherwise(10)
    )
    firm = F.col("_contract") | F.coalesce(F.col("project_stage").isin(*r.firm_stages), F.lit(False)) if r.firm_stages else F.col("_contract")
    stage = F.when(firm, 10).when(F.col("project_stage").isNotNull(), 8).otherwise(0)
    project = (
        F.when(excluded, F.when(F.col("_hasproject"), 3).otherwise(0))
        .when(F.col("_hasproject"), F.least(F.lit(PROJECT_CAP), base + stage))
        .otherwise(0)
    )
    # D22
    relation = F.when(has_party, F.when(F.col("_foreign") & has(r.authority_terms), 15).otherwise(10)).otherwise(0)
    relation = F.least(F.lit(RELATION_CAP), relation + F.when(has_party & has(r.partner_terms), 10).otherwise(0))
    # D23
    key_hit = F.arrays_overlap("industry_tags", _strings(r.key_industries)) if r.key_industries else F.lit(False)
    fit = (
        F.when(excluded, 0)
        .when(key_hit | (F.size("industry_tags") >= 3), 20)
        .when(F.size("industry_tags") > 0, 15)
        .otherwise(0)
    )
    # D24
    senior = F.exists("involved_leaders", lambda p: contains_any(p["title"], r.senior_roles))
    decision = F.when(F.size("involved_leaders") > 0, F.when(senior, 10).otherwise(5)).otherwise(0)
    decision = F.least(F.lit(DECISION_CAP), decision + F.when(F.size("involved_departments") > 0, 5).otherwise(0))
    # D25
    points = F.create_map(*[x for k, v in RELIABILITY_POINTS.items() for x in (F.lit(k), F.lit(v))])
    trust = F.coalesce(F.element_at(points, F.col(reliability)), F.lit(0))
    out = out.withColumns({
        "score_project": project, "score_relationship": relation, "score_fit": fit,
        "score_decision": decision, "score_reliability": trust,
    })
    parts = [F.col(f"score_{n}") for n in ("project", "relationship", "fit", "decision", "reliability")]
    total = F.least(F.lit(TOTAL_CAP), reduce(lambda a, b: a + b, parts))
    out = out.withColumn("relevance_score", F.when(excluded, F.least(total, F.lit(EXCLUDED_CAP))).otherwise(total))
    # D26
    entry = lambda score, matched: F.struct(F.col(score).alias("score"), matched.alias("matched"))
    out = out.withColumn("score_evidence", F.create_map(
        F.lit("project_opportunity"), entry("score_project", F.array_compact(F.array("project_name", "project_stage", "country"))),
        F.lit("customer_relationship"), entry("score_relationship", F.col("external_parties")),
        F.lit("business_fit"), entry("score_fit", F.concat("industry_tags", "product_tags")),
        F.lit("decision_maker"), entry("score_decision", F.concat(F.transform("involved_leaders", lambda p: p["name"]), F.col("involved_departments"))),
        F.lit("source_reliability"), entry("score_reliability", F.array_compact(F.array(F.col(source_type), F.col(reliability)))),
    ))
    # D27
    review = (F.col(source_type) == r.manual_source_type) | (F.col(reliability) == "low")
    who = F.coalesce("entity_alias", F.lit(r.templates.get("unknown_entity", "the monitored group")))
    fact = (
        F.when(F.col("_foreign"), F.concat(F.get("external_parties", F.lit(0)), F.lit(" and "), who, F.lit(" discuss "), F.coalesce("project_stage", F.lit("related business")), F.lit(".")))
        .when(F.size("event_types") > 0, F.concat(who, F.lit(" reports "), F.array_join(F.slice("event_types", 1, 2), ", "), F.lit(".")))
        .otherwise(F.concat(who, F.lit(" published related information.")))
    )
    contacts = F.when(F.size("involved_departments") > 0, F.array_join("involved_departments", ", ")).otherwise(
        F.coalesce("entity_id", F.lit(r.templates.get("default_contact", "overseas or market department")))
    )
    out = out.withColumns({
        "requires_review": F.coalesce(review, F.lit(False)),
        "recommended_contact": contacts,
        "evidence_excerpt": evidence_excerpt(F.col(content)),
        "opportunity": F.substring(
            F.when(F.size("product_tags") > 0, F.concat(F.lit("Possible demand: "), F.array_join(F.slice("product_tags", 1, 4), ", ")))
            .otherwise("No product demand identified yet."), 1, 220),
    })
    return out.withColumns({
        "signal": F.substring(F.concat(fact, F.when(F.col("requires_review"), " Verify with an official source.").otherwise("")), 1, 180),
        "recommended_action": F.substring(
            F.concat(F.lit("Contact "), F.col("recommended_contact"), F.lit(" to confirm name, funding, design stage and procurement dates"),
                     F.when(F.col("country").isNotNull(), F.concat(F.lit("; inform the team in "), F.col("country"))).otherwise(""), F.lit(".")), 1, 260),
    }).drop("_text", "_entity", "_place", "_foreign", "_contract", "_internal", "_stale", "_hasproject")


def score_band(score: Column) -> Column:
    """High from 70, medium 50-69, low 30-49, NULL below."""
    return F.when(score >= 70, "high").when(score >= 50, "medium").when(score >= 30, "low")


def sales_metadata(
    df: DataFrame, title: str, text: str, labels: str, relevant_terms: tuple[str, ...], project_labels: tuple[str, ...],
    procedural_terms: tuple[str, ...], home: str, patterns: tuple[str, ...] = (), strip_prefix: str = "", strip_suffix: str = "",
) -> DataFrame:
    """Relevance flag, home defaults for country and region, overseas rank, counterparty."""
    keyword = contains_any(F.col(text), relevant_terms)
    typed = F.arrays_overlap(F.col(labels), _strings(project_labels))
    procedural = contains_any(F.col(title), procedural_terms) & ~keyword
    country = F.coalesce(F.col("country"), F.when(~F.col("is_overseas"), F.lit(home)))
    region = F.coalesce(F.col("region"), F.when(country == home, F.lit(home)))
    abroad = F.col("is_overseas") | F.coalesce(country != home, F.lit(False)) | F.coalesce(region != home, F.lit(False))
    out = df.withColumns({
        "is_relevant": (keyword | F.coalesce(typed, F.lit(False))) & ~procedural,
        "meta_country": country,
        "meta_region": region,
        "overseas_rank": F.when(abroad, 0).otherwise(1),
    })
    if patterns:
        out = out.withColumn("counterparty", counterparty(F.col(text), patterns, strip_prefix, strip_suffix))
    return out


def counterparty(text: Column, patterns: tuple[str, ...], strip_prefix: str, strip_suffix: str) -> Column:
    """First pattern whose cleaned capture has 2 to 40 characters."""
    from newsloom.functions.text import clean_entity_name

    compact = squeeze(text)

    def capture(p: str) -> Column:
        v = clean_entity_name(F.regexp_extract(compact, p, 1))
        if strip_prefix:
            v = F.regexp_replace(v, strip_prefix, "")
        if strip_suffix:
            v = F.regexp_replace(v, strip_suffix, "")
        v = F.trim(v)
        return F.when(F.char_length(v).between(2, 40), v)

    return F.coalesce(*[capture(p) for p in patterns])
