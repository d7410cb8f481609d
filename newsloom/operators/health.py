"""Source and run health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.skew import counted_broadcast, first_per_key, keyed_lookup

# Failure limit, default schedule, delay limit and terminal states.
PAUSE_AFTER, DEFAULT_MINUTES, HEALTHY_MINUTES, DUE_LIMIT = 5, 1440, 180, 50
TERMINAL = ("success", "empty", "failed", "skipped", "cancelled")
ACTIVE_BACKFILL = ("queued", "running", "paused")
SCHEDULES = (
    (("media", "competitor"), 30), (("official",), 180), (("procurement",), 240), (("chamber", "policy"), 720),
)


def latest_run(runs: DataFrame, source: str = "source_name", at: str = "started_at", run_id: str = "run_id") -> DataFrame:
    """The newest run of each source (highest id on equal times)."""
    columns = [c for c in runs.columns if c != source]
    return first_per_key(runs, [source], [-F.unix_micros(at), -F.col(run_id)], columns)


def with_latest_run(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Source list with the counters of its latest run; ``never`` when it has none."""
    last = latest_run(runs).select(
        "source_name", F.col("status").alias("latest_status"), F.col("fetched_count").alias("latest_fetched"),
        F.col("new_count").alias("latest_new"), F.col("updated_count").alias("latest_updated"),
        F.col("duplicate_count").alias("latest_duplicate"),
    )
    out = sources.join(counted_broadcast(last), "source_name", "left")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("latest_fetched", "latest_new", "latest_updated", "latest_duplicate")}
    out = out.withColumns({**numbers, "latest_status": F.coalesce("latest_status", F.lit("never"))})
    return out.withColumn("latest_skipped", skipped(F.col("latest_fetched"), F.col("latest_new"), F.col("latest_updated"), F.col("latest_duplicate")))


def skipped(fetched: Column, new: Column, updated: Column, duplicate: Column) -> Column:
    """The remainder, never negative."""
    return F.greatest(F.lit(0), fetched - new - updated - duplicate)


def failure_streak(runs: DataFrame, source: str, at: str, run_id: str, failed: Column) -> DataFrame:
    """H2: failures since the last success of each source, and the pause decision.

    Two combined aggregations instead of a window: the last success per source, then the
    failures after it.  A source with a third of all runs never sits in one task.
    """
    mark = F.struct(F.unix_micros(at), F.col(run_id))
    rows = runs.select(source, run_id, mark.alias("_m"), failed.alias("_f"))
    last = rows.groupBy(source).agg(F.max(F.when(~F.col("_f"), F.col("_m"))).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    joined = keyed_lookup(rows, last, [source], run_id, weight="_n")
    after = F.col("_f") & (F.col("_ok").isNull() | (F.col("_m") > F.col("_ok")))
    out = joined.groupBy(source).agg(F.count_if(after).alias("consecutive_failures"))
    return out.withColumn("paused", F.col("consecutive_failures") >= PAUSE_AFTER)


def run_counters(outcomes: DataFrame, run_id: str = "run_id", outcome: str = "outcome") -> DataFrame:
    """Fetched, new, updated, duplicate and skipped per run."""
    n = lambda v: F.count_if(F.col(outcome) == v)
    out = outcomes.groupBy(run_id).agg(
        F.count(F.lit(1)).alias("fetched_count"), n("new").alias("new_count"), n("updated").alias("updated_count"), n("duplicate").alias("duplicate_count")
    )
    return out.withColumn("skipped_count", skipped(*[F.col(c) for c in ("fetched_count", "new_count", "updated_count", "duplicate_count")]))


def backfill_counters(rows: DataFrame, start: datetime, end: datetime, keys: tuple[str, ...] = ("run_id", "page_number")) -> DataFrame:
    """Fetched, undated, kept, outcome counts and the oldest date of each page."""
    at = F.col("published_at")
    inside = at.isNull() | ((at >= F.lit(start)) & (at <= F.lit(end)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fetched_count"),
        F.count_if(at.isNull()).alias("date_unverified_count"),
        F.count_if(inside).alias("kept_count"),
        F.count_if(inside & (F.col("outcome") == "new")).alias("new_count"),
        F.count_if(inside & (F.col("outcome") == "duplicate")).alias("duplicate_count"),
        F.min(at).alias("oldest_published_at"),
        F.coalesce(F.bool_or(at < F.lit(start)), F.lit(False)).alias("reached_start"),
    )


def freshness(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Latest success, running count, delay in minutes and its status."""
    ok = F.col("status") == "success"
    out = runs.agg(
        F.max(F.when(ok, F.col("finished_at"))).alias("last_successful_update"),
        F.max_by("new_count", F.when(ok, F.struct("finished_at", "run_id"))).alias("last_new_count"),
        F.count_if(F.col("status") == "running").alias("running_count"),
    )
    delay = F.floor((F.unix_micros(F.lit(as_of)) - F.unix_micros("last_successful_update")) / 60_000_000)
    out = out.withColumns({"last_new_count": F.coalesce("last_new_count", F.lit(0)), "is_updating": F.col("running_count") > 0, "data_delay_minutes": delay})
    status = F.when(F.col("data_delay_minutes").isNull(), "unknown").when(F.col("data_delay_minutes") <= HEALTHY_MINUTES, "healthy").otherwise("delayed")
    return out.withColumn("delay_status", status)


def batch_progress(batches: DataFrame, items: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Progress and final status of each batch, with the running items and remaining.

    ``items``: batch_id, source_name, status, job_id; ``runs``: job_id and counters.  Running items are counted
    and the first is named; ``current_sources`` lists them as rows, since a batch may run any number.
    """
    n = lambda *v: F.count_if(F.col("status").isin(*v))
    counted = items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("item_count"), n(*TERMINAL).alias("completed_count"), n("success").alias("success_count"),
        n("empty").alias("empty_count"), n("failed").alias("failed_count"), n("skipped", "cancelled").alias("skipped_count"),
        n("running").alias("running_count"), F.min(F.when(F.col("status") == "running", F.col("source_name"))).alias("first_current"),
    )
    out = batches.join(counted, "batch_id", "left")
    if runs is not None:
        sums = items.select("batch_id", "job_id").join(runs, "job_id").groupBy("batch_id").agg(
            *[F.sum(c).alias(c) for c in ("new_count", "updated_count", "duplicate_count")]
        )
        out = out.join(sums, "batch_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("new_count", "updated_count", "duplicate_count")})
    done = (F.col("item_count") > 0) & (F.col("completed_count") == F.col("item_count"))
    final = F.when(F.col("cancel_requested"), "cancelled").when(F.col("failed_count") > 0, "completed_with_errors").otherwise("completed")
    return out.withColumns({
        "status": F.when(done, final).otherwise(F.col("status")),
        "remaining": F.greatest(F.lit(0), F.col("item_count") - F.coalesce("completed_count", F.lit(0))),
    })


def current_sources(items: DataFrame) -> DataFrame:
    """(batch_id, source_name) of the items that run right now."""
    return items.filter(F.col("status") == "running").select("batch_id", "source_name")


def runnable() -> Column:
    """Enabled, active and not a manual source."""
    return (
        F.col("enabled") & (F.col("adapter_status") == "active")
        & (F.col("crawl_method") != "manual_import") & (F.col("source_type") != "manual")
    )


def work_list(sources: DataFrame) -> DataFrame:
    """M7: each source queued, or skipped with its reason."""
    return sources.select(
        "source_name",
        F.when(runnable(), "queued").otherwise("skipped").alias("status"),
        F.when(~runnable(), F.concat_ws("/", "adapter_status", "crawl_method")).alias("skip_reason"),
    )


def overdue_sources(sources: DataFrame, as_of: datetime, n: int = DUE_LIMIT) -> DataFrame:
    """C20: runnable sources past their next run, oldest first."""
    return sources.filter(runnable() & (F.col("next_run_at") <= F.lit(as_of))).orderBy("next_run_at", "source_name").limit(n)


def next_run(at: Column, minutes: Column) -> Column:
    """H8: time plus schedule, one day by default (0 counts as unset)."""
    m = F.coalesce(F.nullif(minutes, F.lit(0)), F.lit(DEFAULT_MINUTES))
    return at + F.make_dt_interval(F.lit(0), F.lit(0), m)


def gap_report(sources: DataFrame, backfills: DataFrame) -> DataFrame:
    """Sources in scope, marked by whether a backfill is already active."""
    active = backfills.filter(F.col("status").isin(*ACTIVE_BACKFILL)).select("source_name").distinct()
    scope = sources.filter((F.col("adapter_status") == "active") & F.col("backfill_enabled")).select("source_name")
    marked = scope.join(counted_broadcast(active.withColumn("_a", F.lit(True))), "source_name", "left")
    return marked.select("source_name", F.when(F.col("_a"), "already_active").otherwise("queued").alias("decision"))


def source_attributes(catalog: DataFrame, blocked_words: tuple[str, ...], adapters: DataFrame, tag_rules: tuple[tuple[str, Column], ...]) -> DataFrame:
    """Schedule by type, adapter status precedence and sorted tags.

    ``adapters``: source_name, initial_status of the sources with a reader.
    """
    schedule = F.when(F.col("crawl_method") == "manual_import", F.lit(None).cast("int"))
    for kinds, minutes in SCHEDULES:
        schedule = schedule.when(F.col("source_type").isin(*kinds), minutes)
    notes = F.lower(F.coalesce("notes", F.lit("")))
    blocked = F.lit(False)
    for w in blocked_words:
        blocked = blocked | notes.contains(w)
    out = catalog.join(counted_broadcast(adapters.select("source_name", F.col("initial_status").alias("_init"), F.lit(True).alias("_has"))), "source_name", "left")
    status = (
        F.when((F.col("crawl_method") == "manual_import") | (F.col("source_type") == "manual"), "manual_only")
        .when(~F.col("enabled"), "disabled")
        .when(blocked, "blocked")
        .when(F.col("_has"), F.coalesce("_init", F.lit("active")))
        .otherwise("pending_adapter")
    )
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for tag, cond in tag_rules]))
    return out.withColumns({
        "schedule_minutes": schedule.otherwise(DEFAULT_MINUTES),
        "adapter_status": status,
        "source_tags": F.array_sort(F.array_distinct(tags)),
    }).drop("_init", "_has")
