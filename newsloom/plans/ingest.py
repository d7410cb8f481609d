"""Full ingest of a batch of items (E23 with everything it feeds)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import content_digest, event_key, rule_summary
from newsloom.functions.urls import canonical_url
from newsloom.operators import dedup, events, governance, tagging
from newsloom.operators.scoring import analyze
from newsloom.rules import Alias, Gazetteer, RelevanceRules, Rule
from newsloom.session import cut_lineage
from newsloom.skew import first_per_key


@dataclass(frozen=True)
class IngestConfig:
    """Rule tables and settings of one ingest."""

    gazetteer: Gazetteer
    aliases: Sequence[Alias]
    company_context: Sequence[str]
    overseas_context: Sequence[str]
    labels: Sequence[Rule]
    project_labels: Sequence[str]
    actions: Sequence[Rule]
    relevance: RelevanceRules
    label_fallbacks: Sequence[tuple[str, str, Sequence[str]]] = ()
    label_rollup: tuple[str, Sequence[str]] | None = None
    product_rules: Sequence[tuple[Sequence[str], Sequence[str]]] = ()
    product_default: Sequence[str] = ()
    own_types: Sequence[str] = ("official", "procurement", "stock_disclosure", "policy", "chamber", "competitor")
    official_types: Sequence[str] = ("official", "procurement", "stock_disclosure", "policy")
    manual_type: str = "manual"
    home_country: str = "home"
    governed_tag: str = "governed"
    governance: governance.GovernanceRules | None = None
    policy_labels: Sequence[str] = ()
    tax_terms: Sequence[str] = ()
    policy_routes: dict[str, str] = field(default_factory=dict)
    leader_patterns: tuple[str, str, str] | None = None
    leader_label: str = "leader"
    leader_actions: Sequence[str] = ("meeting", "appointment")
    activities: Sequence[tuple[str, str]] = ()
    account_topic: str = "account"
    measure: str = "sequence"
    manual: bool = False


def tag_items(items: DataFrame, sources: DataFrame, c: IngestConfig) -> DataFrame:
    """Everything up to the cascade: one stage of column work after the source lookup.

    ``sources`` (a few thousand rows) is joined by name; AQE broadcasts it when it is small.
    """
    src = sources.select(
        "source_name", "source_type", "reliability_level", "source_tags", F.col("entity_id").alias("source_entity_id"),
        F.concat_ws(" ", "source_name", "country_focus", "region_focus").alias("_scope"),
        F.concat_ws(" ", "industry_focus").alias("_industry"),
    )
    df = items.join(src, "source_name", "left")
    df = governance.effective_source(df, c.manual_type)
    df = df.withColumns({
        "url_key": canonical_url(F.col("url")),
        "hash_key": content_digest(F.col("title"), F.col("excerpt")),
        "text": F.concat_ws("\n", "title", "excerpt"),
        "is_first_party": governance.first_party(F.col("source_type"), F.col("link_only"), c.own_types),
    })
    # The source's own scope counts as evidence for the gate.
    df = df.withColumn("_gate", F.concat_ws("\n", "text", "_scope"))
    df = tagging.country_gate(df, "_gate", c.gazetteer)
    hit = F.lit(False)
    if c.governance:
        df = governance.leadership(df, "text", c.governance)
        df = df.withColumn("org_change", governance.org_change(F.col("text"), c.governance, fallback=False))
        hit = F.col("person_name").isNotNull() | F.col("org_change").isNotNull()
    tags = F.coalesce("source_tags", F.array().cast("array<string>"))
    df = df.withColumn("route", governance.feed_route(F.col("is_overseas"), tags, c.governed_tag, hit, F.lit(c.manual)))
    conf = F.when(F.col("route") == "governance", 0.75).when(F.col("route") == "manual_review", 0.2).otherwise(F.col("overseas_confidence"))
    df = df.withColumns({
        "country": F.when(F.col("route") == "governance", c.home_country).otherwise(F.col("country")),
        "region": F.when(F.col("route") == "governance", c.home_country).otherwise(F.col("region")),
        "is_overseas": F.col("is_overseas") | (F.col("route") == "manual_review"),
        "overseas_confidence": conf,
        "eligible": F.col("route") != "skipped",
    })
    df = df.withColumn("_alias_text", F.concat_ws("\n", "text", "source_name"))
    df = tagging.account_candidates(df, "_alias_text", c.aliases, c.company_context, c.overseas_context)
    df = df.withColumns({
        "intelligence_types": tagging.intelligence_labels(F.col("text"), c.labels, F.col("effective_type"), c.label_fallbacks, c.label_rollup),
        "industries": tagging.first_list(F.concat_ws(" ", "_industry", "text"), c.product_rules, c.product_default),
        "confidence": tagging.article_confidence(F.col("overseas_confidence"), F.col("candidates")),
    })
    key = events.event_fingerprint(
        F.col("title"), F.col("published_at"), F.col("country"), F.col("candidates"), F.col("intelligence_types"),
        c.project_labels, tagging.first_label(F.col("title"), c.actions),
    )
    return df.withColumn("event_key", key).drop("_gate", "_scope", "_alias_text", "_industry")


def accept_articles(cascade: DataFrame, c: IngestConfig) -> DataFrame:
    """Article columns of the accepted items; T5: the project stage is stored too."""
    new = cascade.filter("outcome = 'new'").withColumnsRenamed({"country": "gate_country", "region": "gate_region"})
    out = analyze(new, c.relevance, "title", "excerpt", "effective_type", "effective_reliability")
    out = out.withColumns({"country": F.coalesce("country", "gate_country"), "region": F.coalesce("region", "gate_region")})
    return out.withColumns({
        "summary": rule_summary(F.coalesce(F.nullif("excerpt", F.lit("")), F.col("title"))),
        "project_key": F.when(
            F.arrays_overlap("intelligence_types", tagging._strings(c.project_labels)),
            events.project_fingerprint(F.col("title"), F.col("country"), F.col("candidates"), F.col("intelligence_types"), c.project_labels),
        ),
        "project_type": F.get(F.filter("intelligence_types", lambda x: x.isin(*c.project_labels)), F.lit(0)),
        "date_verification_status": F.when(F.col("published_at").isNull(), "date_unverified").otherwise("verified"),
        "verification_status": F.when(F.col("is_first_party"), "source_verified").otherwise("unverified"),
        "review_status": F.lit("pending"),
        "article_id": F.col("arrival_seq"),
    })


def derived_tables(articles: DataFrame, c: IngestConfig, stored: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """New policy, leader, activity, personnel and organisation rows of the accepted articles.

    Only the tables whose rules are configured are built.  The last three cover governed sources and
    articles with the account topic, and hold one row per event key (first article); keys in ``stored`` stay.
    """
    out: dict[str, DataFrame] = {}
    if c.policy_labels:
        out["policies"] = tagging.policy_dimensions(articles, "text", "intelligence_types", c.policy_labels, c.tax_terms, c.policy_routes)
    if c.leader_patterns:
        acted = articles.withColumn("action", tagging.first_label(F.col("text"), c.actions))
        out["leader_events"] = governance.leader_event(acted, "text", "intelligence_types", "action", *c.leader_patterns, c.leader_label, c.leader_actions)
    none = F.array().cast("array<string>")
    scope = articles.filter(
        F.array_contains(F.coalesce("source_tags", none), c.governed_tag) | F.array_contains(F.coalesce("topic_tags", none), c.account_topic)
    )
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("date-unverified"))
    if c.activities:
        rows = events.business_activities(scope.drop("event_key").withColumn("event_id", F.col("article_id")), c.activities, "source_entity_id", "event_id", "published_at")
        firsts = rows.groupBy("event_key").agg(F.min("arrival_seq").alias("arrival_seq"))
        if "activities" in stored:
            firsts = firsts.join(stored["activities"].select("event_key"), "event_key", "left_anti")
        out["activities"] = rows.join(firsts, ["event_key", "arrival_seq"], "left_semi")
    if c.governance:
        people = scope.filter("role_change")
        key = event_key(F.col("source_entity_id"), F.col("person_name"), F.col("appointment_type"), day, F.col("event_key"))
        out["personnel_events"] = events.insert_if_absent(stored.get("personnel_events"), people.withColumn("change_key", key), "change_key")
        moved = scope.withColumn("change_type", governance.org_change(F.col("text"), c.governance)).filter("change_type is not null")
        key = event_key(F.col("source_entity_id"), F.col("change_type"), day, F.col("event_key"))
        out["org_events"] = events.insert_if_absent(stored.get("org_events"), moved.withColumn("change_key", key), "change_key")
    return out


def _after(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Stored rows and new ones, in the columns of the new ones."""
    return rows if stored is None else stored.select(rows.columns).unionByName(rows)


def merge_projects(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """The projects of this batch with what is stored of them: name and first event stay, the rest grows."""
    if stored is None:
        return new
    old = stored.select("project_key", *[F.col(c).alias(f"_{c}") for c in ("name", "first_event_at", "last_event_at", "event_count")])
    known = F.col("_event_count").isNotNull()
    return new.join(old, "project_key", "left").select(
        "project_key", F.when(known, F.col("_name")).otherwise(F.col("name")).alias("name"),
        F.when(known, F.col("_first_event_at")).otherwise(F.col("first_event_at")).alias("first_event_at"),
        F.greatest("_last_event_at", "last_event_at").alias("last_event_at"), (F.col("event_count") + F.coalesce("_event_count", F.lit(0))).alias("event_count"),
    )


def ingest(items: DataFrame, sources: DataFrame, c: IngestConfig, as_of: datetime, stored: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Run the ingest of a batch and return the rows that it adds or changes.

    Besides those of ``derived_tables``: outcomes (one row per item), articles (accepted or touched, with promotion and
    source counts), duplicates (ledger), evidence (article sources), event_sources (sources of an article's event, with the
    role of the evidence at their address), events and projects (roll-ups).

    ``stored`` holds these tables as earlier batches left them; ``arrival_seq`` grows from batch to batch.  Articles and
    events are then upserted by ``article_id``, projects by ``project_key``; all other rows are appended.
    """
    stored = stored or {}
    tagged = cut_lineage(tag_items(items, sources, c), "tagged")
    cascade = cut_lineage(dedup.ingest_cascade(tagged, as_of, c.measure, existing=stored.get("articles")), "cascade")
    accepted = cut_lineage(accept_articles(cascade, c), "articles")
    attached = cascade.filter("outcome <> 'skipped'").select(
        F.coalesce("leader_seq", "arrival_seq").alias("article_id"), "arrival_seq", "url", "source_name",
        F.col("effective_type").alias("source_type"), F.col("effective_reliability").alias("reliability_level"),
        "published_at", F.col("is_first_party").alias("first_party"),
        tagging.source_role(F.col("effective_type"), F.col("source_name"), F.col("language"), c.official_types, c.manual_type).alias("source_role"),
    )
    touched = attached.select("article_id").distinct()
    before = {n: stored[n].join(touched, "article_id", "left_semi") for n in ("articles", "evidence", "event_sources") if n in stored}

    evidence = cut_lineage(dedup.attach_sources(_after(before.get("evidence"), attached)), "evidence")
    at_address = attached.select("article_id", "arrival_seq", "url", "source_name", "published_at").join(evidence.select("article_id", "url", "source_role"), ["article_id", "url"])
    linked = _after(before.get("event_sources"), at_address.select("article_id", "source_name", "arrival_seq", "source_role", "published_at"))
    linked = cut_lineage(first_per_key(linked, ["article_id", "source_name"], [F.col("arrival_seq")], ["arrival_seq", "source_role", "published_at"]), "event-sources")

    new = accepted.withColumns({"source_type": F.col("effective_type"), "reliability_level": F.col("effective_reliability"), "is_primary_source": F.col("is_first_party")})
    counts = events.distinct_sources(evidence, "article_id", "source_name")
    promoted = dedup.promote_primary(_after(before.get("articles"), new), attached.filter(F.col("arrival_seq") != F.col("article_id")))
    articles = cut_lineage(promoted.join(counts, "article_id", "left").withColumn("cross_source_count", F.coalesce("cross_source_count", F.lit(1))), "final")

    head = articles.select(
        "event_key", "article_id", "title", F.col("published_at").alias("event_at"), "country", "region", "project_key",
        tagging.first_label(F.col("text"), c.actions).alias("event_type"), F.get("candidates", F.lit(0))["account"].alias("company_name"),
        F.transform("candidates", lambda x: x["matched_entity"]).alias("matched_entities"), "intelligence_types", "confidence",
    )
    by_event = events.event_rollup(linked.join(head.select("article_id", "event_key"), "article_id"))
    keys = accepted.filter("project_key is not null").select("project_key", "title", F.col("published_at").alias("event_at"), "arrival_seq")
    duplicates = dedup.duplicate_ledger(cascade, "url")
    if "duplicates" in stored:
        duplicates = duplicates.join(stored["duplicates"].select("url"), "url", "left_anti")
    own = cascade.select("arrival_seq")
    return {
        "outcomes": cascade.select("arrival_seq", "outcome", "match_method", "leader_seq", "match_score", "route"),
        "articles": articles,
        "duplicates": duplicates,
        "evidence": evidence.join(own, "arrival_seq", "left_semi"),
        "event_sources": linked.join(own, "arrival_seq", "left_semi"),
        "events": head.join(by_event, "event_key", "left"),
        "projects": merge_projects(stored.get("projects"), events.project_rollup(keys)),
        **derived_tables(accepted, c, stored),
    }
