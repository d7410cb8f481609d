"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

_S, _L, _I, _B, _TS, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DoubleType()
_AS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ITEMS = _struct(
    arrival_seq=_L, source_name=_S, title=_S, url=_S, published_at=_TS, author=_S,
    excerpt=_S, language=_S, link_only=_B,
)

SOURCES = _struct(
    source_name=_S, source_url=_S, source_type=_S, reliability_level=_S, region_focus=_AS,
    country_focus=_AS, industry_focus=_AS, source_tags=_AS, entity_id=_S, crawl_method=_S,
    adapter_status=_S, schedule_minutes=_I, enabled=_B, consecutive_failures=_I,
    next_run_at=_TS, backfill_status=_S, backfill_enabled=_B,
)

LEADER = _struct(name=_S, title=_S, role_in_event=_S)
EVIDENCE = T.MapType(_S, _struct(score=_I, matched=_AS))

ARTICLES = _struct(
    id=_S, title=_S, display_title=_S, summary=_S, content_excerpt=_S, canonical_url=_S, content_hash=_S,
    source_name=_S, source_type=_S, reliability_level=_S, published_at=_TS, fetched_at=_TS,
    country=_S, region=_S, project_stage=_S, canonical_event_id=_S, ka=_AS, matched_entities=_AS,
    external_parties=_AS, event_types=_AS, involved_leaders=T.ArrayType(LEADER), industries=_AS,
    industry_tags=_AS, topic_tags=_AS, intelligence_types=_AS, sales_relevance_score=_I,
    sales_score_evidence=EVIDENCE, confidence_score=_D, cross_source_count=_I, is_primary_source=_B,
    is_overseas=_B, is_demo=_B, review_status=_S, verification_status=_S,
)

RULES = _struct(
    rule_set=_S, rule_id=_I, priority=_I, label=_S, term=_S,
    weight=T.DecimalType(5, 2), strength=_S, case_sensitive=_B,
)

ORG_ENTITIES = _struct(
    entity_id=_S, canonical_name=_S, short_name=_S, aliases=_AS, parent_entity_id=_S, entity_level=_S,
    entity_type=_S, stock_code=_S, official_url=_S, country=_S, region=_S, overseas=_B,
    verification_status=_S, verification_source=_S, active=_B, notes=_S,
)

CRAWL_RUNS = _struct(
    run_id=_L, source_name=_S, status=_S, started_at=_TS, finished_at=_TS, fetched_count=_L,
    new_count=_L, updated_count=_L, duplicate_count=_L, failure_reason=_S,
)

FILTERS = _struct(
    q=_S, date_from=_S, date_to=_S, region=_S, country=_S, industry=_S, intelligence_type=_S,
    policy_type=_S, ka_group=_S, matched_entity=_S, source=_S, source_type=_S, reliability=_S,
    review_status=_S, verification_status=_S, project_stage=_S, sort=_S,
)
