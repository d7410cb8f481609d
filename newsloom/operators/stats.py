"""Aggregated answers over articles and events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT_DAYS = 30
#: Logarithm of a sketch's size; the standard error is 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 14


def statistics_base(articles: DataFrame, as_of: datetime, days: int = 365) -> DataFrame:
    """Dated, in-window, non-demo, overseas, not rejected."""
    start = F.lit(as_of - timedelta(days=days))
    return articles.filter(
        F.col("is_overseas") & ~F.col("is_demo") & (F.col("review_status") != "rejected")
        & F.col("published_at").isNotNull() & (F.col("published_at") >= start)
    ).withColumn("event_identity", F.coalesce("canonical_event_id", "content_hash"))


def distinct_events_by(df: DataFrame, column: str) -> DataFrame:
    """G1: distinct events per value, most active first, NULL dropped.

    Distinct is two plain aggregations: (value, event) pairs are combined on the map side, so
    a value with a third of the rows is counted from its events, not its rows.
    """
    pairs = df.filter(F.col(column).isNotNull()).groupBy(column, "event_identity").agg(F.count(F.lit(1)).alias("_n"))
    counted = pairs.filter(F.col("event_identity").isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("event_count"))
    return counted.orderBy(F.desc("event_count"), column)


def distinct_events_by_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """G1: the same count for several columns in one pass: (dimension, value, event_count)."""
    entries = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select("event_identity", F.explode(entries).alias("e")).select("event_identity", "e.*")
    long = long.filter("value is not null and event_identity is not null").distinct()
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("event_count"))


def daily_sketches(df: DataFrame, at: str, columns: list[str], identity: str = "event_identity", lg_k: int = SKETCH_BITS) -> DataFrame:
    """L8, G1-G3 as an option: one mergeable sketch of distinct events per day and value; a day is sketched once and kept."""
    rows = df.filter(F.col(identity).isNotNull() & F.col(at).isNotNull())
    return rows.groupBy(F.to_date(at).alias("day"), *columns).agg(F.hll_sketch_agg(identity, F.lit(lg_k)).alias("sketch"))


def sketched_counts(sketches: DataFrame, as_of: datetime, days: int, columns: list[str]) -> DataFrame:
    """Distinct events of the last ``days`` days per value, from the stored daily sketches alone."""
    start = F.to_date(F.lit(as_of - timedelta(days=days)))
    inside = sketches.filter((F.col("day") >= start) & (F.col("day") <= F.to_date(F.lit(as_of))))
    return inside.groupBy(*columns).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def conditional_event_counts(df: DataFrame, conditions: dict[str, Column], identity: str = "event_identity") -> DataFrame:
    """Distinct events overall and under each condition, in one row.

    Rows are first reduced to one row of flags per event, then counted, instead of one
    expanded copy of the data per distinct count.
    """
    flags = {name: F.max(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in conditions.items()}
    per_event = df.filter(F.col(identity).isNotNull()).groupBy(identity).agg(*flags.values())
    return per_event.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(n)).alias(n) for n in flags])


def with_ratios(df: DataFrame, ratios: dict[str, str], total: str = "total") -> DataFrame:
    """Share of the total rounded to four places, 0 when empty."""
    return df.withColumns({
        name: F.when(F.col(total) > 0, F.bround(F.col(part) / F.col(total), 4)).otherwise(0.0) for name, part in ratios.items()
    })


def dashboard(articles: DataFrame, as_of: datetime, families: dict[str, list[str]], labels: str = "intelligence_types") -> DataFrame:
    """Totals, recent, high trust, cross-source, pending and label families."""
    base = statistics_base(articles, as_of)
    conditions = {
        "recent_30": F.col("published_at") >= F.lit(as_of - timedelta(days=RECENT_DAYS)),
        "high_reliability": F.col("reliability_level") == "high",
        "cross_source": F.col("cross_source_count") >= 2,
        "pending_review": F.col("review_status").isin("pending", "needs_changes"),
    }
    for name, members in families.items():
        conditions[name] = F.arrays_overlap(labels, F.array(*[F.lit(m) for m in members]))
    counts = conditional_event_counts(base, conditions)
    return with_ratios(counts, {"high_reliability_ratio": "high_reliability", "cross_verified_ratio": "cross_source"})


def facets(events: DataFrame, kind: str, arrays: dict[str, str]) -> DataFrame:
    """(facet, value, n) for a scalar column and several array columns in one pass."""
    entries = [F.array(F.struct(F.lit("event_type").alias("facet"), F.coalesce(kind, F.lit("unknown")).alias("value")))]
    for name, column in arrays.items():
        entries.append(_facet_entries(name, column))
    long = events.select(F.explode(F.concat(*entries)).alias("e")).select("e.*")
    return long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def _facet_entries(name: str, column: str) -> Column:
    values = F.coalesce(column, F.array().cast("array<string>"))
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))


def source_health_counts(sources: DataFrame) -> DataFrame:
    """Failing, backfill completed, pending and unsupported sources."""
    status = F.col("backfill_status")
    return sources.agg(
        F.count_if(F.col("enabled") & (F.col("consecutive_failures") > 0)).alias("failed_sources"),
        F.count_if(status == "completed").alias("backfill_completed"),
        F.count_if(F.col("backfill_enabled") & ~status.isin("completed", "unsupported")).alias("backfill_pending"),
        F.count_if(~F.col("backfill_enabled") | (status == "unsupported")).alias("backfill_unsupported"),
    )


def top_values(counts: DataFrame, n: int | None, value: str = "value", count: str = "event_count") -> DataFrame:
    """Top 10, 20 or all bars."""
    ordered = counts.orderBy(F.desc(count), value)
    return ordered if n is None else ordered.limit(n)
