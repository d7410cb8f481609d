"""Query catalogue over the test tables: each module gives ``QUERIES`` and ``ORACLE``."""

from newsloom.plans.showcase import entity_queries, governance_queries, health_queries, ingest_queries, page_queries, search_queries, stat_queries, stream_queries, tag_queries, text_queries

MODULES = (
    text_queries, tag_queries, search_queries, stat_queries, health_queries, page_queries, entity_queries, governance_queries, ingest_queries, stream_queries,
)


def queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
