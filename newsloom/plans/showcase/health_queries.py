"""Source and run health (G5, G7-G9, G13, G14, H, M7, M8, D39, A15)."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsloom.operators import health, stats
from newsloom.plans.showcase.base import docs, table
from newsloom.sources import catalog
from newsloom.streaming.jobs import backfill_window, checkpoint_rows

RUNS_AS_OF = datetime(2024, 1, 31, 1, 30, tzinfo=timezone.utc)
num = lambda c: F.col(c).cast("bigint").alias(c)
ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def runs(spark, sf):
    """Crawl runs from the event stream: errors failed, signups are still running."""
    e = table(spark, sf, "events")
    part = lambda k: F.floor(F.col("value") / k).cast("bigint")
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("source_name"), "event_type",
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("success").alias("status"),
        at.alias("started_at"), F.when(F.col("event_type") != "signup", at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5))).alias("finished_at"),
        part(1).alias("fetched_count"), part(2).alias("new_count"), part(4).alias("updated_count"), part(8).alias("duplicate_count"),
    )


RUNS_CTE = """runs AS (SELECT event_id AS run_id, user_id AS source_name, event_type, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS status,
  ts AS started_at, CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 5 MINUTE END AS finished_at, CAST(floor(value) AS BIGINT) AS fetched_count, CAST(floor(value / 2) AS BIGINT) AS new_count,
  CAST(floor(value / 4) AS BIGINT) AS updated_count, CAST(floor(value / 8) AS BIGINT) AS duplicate_count FROM events)"""


def sources(spark, sf):
    """A source list from the suppliers."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    return s.select(
        F.col("s_name").alias("source_name"), pick(("official", "media", "procurement", "policy", "manual", "other", "chamber"), 7).alias("source_type"),
        pick(("active", "active", "paused", "pending_adapter", "active"), 5).alias("adapter_status"), pick(("rss", "html", "manual_import"), 3).alias("crawl_method"),
        (k % 8 != 3).alias("enabled"), (k % 7).cast("int").alias("consecutive_failures"),
        pick(("completed", "not_started", "unsupported", "running"), 4).alias("backfill_status"), (k % 6 != 1).alias("backfill_enabled"),
        (F.lit("2024-01-30").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (k * 37 % 4000).cast("int"))).alias("next_run_at"),
        F.when(k % 9 == 2, F.lit("Needs a licence, PAID")).otherwise("").alias("notes"), pick((30, 0, 180), 3).alias("minutes"),
        F.col("s_nationkey").alias("nation"), k.alias("k"),
    )


def _lst(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SOURCES_CTE = f"""src AS (SELECT s_name AS source_name, {_lst(('official', 'media', 'procurement', 'policy', 'manual', 'other', 'chamber'))}[s_suppkey % 7 + 1] AS source_type,
  {_lst(('active', 'active', 'paused', 'pending_adapter', 'active'))}[s_suppkey % 5 + 1] AS adapter_status, {_lst(('rss', 'html', 'manual_import'))}[s_suppkey % 3 + 1] AS crawl_method,
  s_suppkey % 8 <> 3 AS enabled, s_suppkey % 7 AS consecutive_failures, {_lst(('completed', 'not_started', 'unsupported', 'running'))}[s_suppkey % 4 + 1] AS backfill_status, s_suppkey % 6 <> 1 AS backfill_enabled,
  TIMESTAMP '2024-01-30' + to_minutes(s_suppkey * 37 % 4000) AS next_run_at, CASE WHEN s_suppkey % 9 = 2 THEN 'Needs a licence, PAID' ELSE '' END AS notes, [30, 0, 180][s_suppkey % 3 + 1] AS minutes,
  s_nationkey AS nation, s_suppkey AS k FROM supplier),
ok AS (SELECT *, enabled AND adapter_status = 'active' AND crawl_method <> 'manual_import' AND source_type <> 'manual' AS runnable FROM src)"""


def latest_run(spark, sf):
    return health.latest_run(runs(spark, sf)).select("source_name", "run_id", "status", ts("started_at"), "fetched_count")


def failure_streak(spark, sf):
    out = health.failure_streak(runs(spark, sf), "source_name", "started_at", "run_id", F.col("status") == "failed")
    return out.select("source_name", num("consecutive_failures"), "paused")


def run_counters(spark, sf):
    names = {"click": "new", "view": "updated", "purchase": "duplicate"}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    o = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.coalesce(F.element_at(label, F.col("event_type")), F.lit("skipped")).alias("outcome"))
    return health.run_counters(o)


def _backfill(spark, sf):
    d = docs(spark, sf)
    return d.select((F.col("doc_id") % 5).alias("run_id"), F.floor(F.col("doc_id") / 50).alias("page_number"), "doc_id", "published_at", F.when(F.col("doc_id") % 4 == 0, "duplicate").otherwise("new").alias("outcome"))


START, END = datetime(2024, 2, 1, tzinfo=timezone.utc), datetime(2024, 12, 1, tzinfo=timezone.utc)


def backfill_counters(spark, sf):
    out = health.backfill_counters(_backfill(spark, sf), START, END)
    return out.select("run_id", "page_number", "fetched_count", "date_unverified_count", "kept_count", "new_count", "duplicate_count", F.date_format("oldest_published_at", "yyyy-MM-dd").alias("oldest"), "reached_start")


def backfill_resume(spark, sf):
    rows = _backfill(spark, sf)
    done = checkpoint_rows(rows.filter("page_number < 2"), START, END)
    return backfill_window(rows, datetime(2024, 1, 1, tzinfo=timezone.utc), END, done).groupBy("run_id", "page_number").agg(F.count(F.lit(1)).alias("n"))


def freshness(spark, sf):
    out = health.freshness(runs(spark, sf), RUNS_AS_OF)
    return out.select(ts("last_successful_update"), num("last_new_count"), num("running_count"), "is_updating", num("data_delay_minutes"), "delay_status")


def batch_progress(spark, sf):
    r = runs(spark, sf)
    kinds = F.get(F.array(*[F.lit(x) for x in ("success", "empty", "failed", "skipped", "running", "success", "cancelled")]), (F.col("run_id") % 7).cast("int"))
    items = r.select((F.col("source_name") % 10).alias("batch_id"), F.col("source_name").cast("string").alias("source_name"), F.when(F.col("source_name") % 10 > 6, "success").otherwise(kinds).alias("status"), F.col("run_id").alias("job_id"))
    batches = items.select("batch_id").distinct().withColumns({"status": F.lit("running"), "cancel_requested": F.col("batch_id") == 8})
    out = health.batch_progress(batches, items, r.select(F.col("run_id").alias("job_id"), "new_count", "updated_count", "duplicate_count"))
    return out.select("batch_id", "status", "item_count", "completed_count", "failed_count", "skipped_count", "first_current", "running_count", "remaining", "new_count", "updated_count", "duplicate_count")


def work_list(spark, sf):
    return health.work_list(sources(spark, sf))


def overdue(spark, sf):
    return health.overdue_sources(sources(spark, sf), RUNS_AS_OF).select("source_name", ts("next_run_at"))


def gap_report(spark, sf):
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("source_name"), F.when(F.col("s_suppkey") % 4 == 0, "running").when(F.col("s_suppkey") % 4 == 1, "completed").otherwise("failed").alias("status"))
    return health.gap_report(sources(spark, sf), b)


def source_attributes(spark, sf):
    s = sources(spark, sf)
    adapters = s.filter("k % 2 = 0").select("source_name", F.when(F.col("k") % 4 == 0, "blocked").alias("initial_status"))
    rules = (("competitor", F.col("source_type") == "competitor"), ("official_owner", F.col("source_type") == "official"), ("governed", F.col("nation") < 5), ("manual_only", F.col("source_type") == "manual"))
    out = health.source_attributes(s, ("paid", "subscription"), adapters, rules)
    return out.select("source_name", num("schedule_minutes"), "adapter_status", F.array_join("source_tags", "|").alias("tags"))


def next_runs(spark, sf):
    return sources(spark, sf).select("source_name", F.date_format(health.next_run(F.col("next_run_at"), F.col("minutes")), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


def source_health(spark, sf):
    out = stats.source_health_counts(sources(spark, sf))
    return out.select(*[num(c) for c in out.columns])


def source_list(spark, sf):
    """Every source with its latest run counters."""
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_name"))
    out = health.with_latest_run(s, runs(spark, sf))
    return out.select("source_name", "latest_status", num("latest_fetched"), num("latest_new"), num("latest_skipped"))


def catalog_upsert(spark, sf):
    s = sources(spark, sf)
    cols = ["source_name", "source_type", "adapter_status", "enabled", "schedule_minutes", "consecutive_failures", "next_run_at", "backfill_status", "backfill_enabled"]
    shaped = s.withColumn("schedule_minutes", F.nullif("minutes", F.lit(0)))
    stored = shaped.filter("k % 10 <> 0").select(cols)
    incoming = shaped.filter("k % 10 <> 9").withColumns({"adapter_status": F.when(F.col("k") % 3 == 0, "active").otherwise("disabled"), "enabled": F.lit(True), "schedule_minutes": F.lit(99), "source_type": F.lit("renewed"), "backfill_enabled": F.lit(True), "next_run_at": F.lit(None).cast("timestamp")}).select(cols)
    out = catalog.upsert_catalog(stored, incoming, "2024-02-01 00:00:00")
    return out.select("source_name", "source_type", "adapter_status", "enabled", num("schedule_minutes"), "backfill_enabled", ts("next_run_at"))


QUERIES = {
    "latest_run": latest_run, "failure_streak": failure_streak, "run_counters": run_counters, "backfill_counters": backfill_counters, "backfill_resume": backfill_resume,
    "freshness": freshness, "batch_progress": batch_progress, "work_list": work_list, "overdue_sources": overdue, "gap_report": gap_report,
    "source_attributes": source_attributes, "next_runs": next_runs, "source_health": source_health, "source_list": source_list, "catalog_upsert": catalog_upsert,
}

_T = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_BF = """p AS (SELECT doc_id % 5 AS run_id, doc_id // 50 AS page_number, doc_id, CASE WHEN doc_id % 37 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) END AS ats,
  CASE WHEN doc_id % 4 = 0 THEN 'duplicate' ELSE 'new' END AS outcome FROM documents)"""

ORACLE = {
    "latest_run": f"""WITH {RUNS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, run_id DESC) AS rn FROM runs)
        SELECT source_name, run_id, status, {_T('r.started_at')} AS started_at, fetched_count FROM r WHERE rn = 1""",
    "failure_streak": f"""WITH {RUNS_CTE}, r AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_name ORDER BY started_at, run_id) AS island FROM runs),
        m AS (SELECT source_name, max(island) AS last FROM r GROUP BY 1)
        SELECT source_name, CAST(count(*) FILTER (status = 'failed' AND island = last) AS BIGINT) AS consecutive_failures, count(*) FILTER (status = 'failed' AND island = last) >= 5 AS paused FROM r JOIN m USING (source_name) GROUP BY 1""",
    "run_counters": """SELECT user_id AS run_id, count(*) AS fetched_count, count(*) FILTER (event_type = 'click') AS new_count, count(*) FILTER (event_type = 'view') AS updated_count,
        count(*) FILTER (event_type = 'purchase') AS duplicate_count, count(*) FILTER (event_type IN ('error', 'signup')) AS skipped_count FROM events GROUP BY 1""",
    "backfill_counters": f"""WITH {_BF} SELECT run_id, page_number, count(*) AS fetched_count, count(*) FILTER (ats IS NULL) AS date_unverified_count, count(*) FILTER (ins) AS kept_count,
        count(*) FILTER (ins AND outcome = 'new') AS new_count, count(*) FILTER (ins AND outcome = 'duplicate') AS duplicate_count, strftime(min(ats), '%Y-%m-%d') AS oldest, coalesce(bool_or(ats < TIMESTAMP '2024-02-01'), FALSE) AS reached_start
        FROM (SELECT *, ats IS NULL OR ats BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-12-01' AS ins FROM p) GROUP BY 1, 2""",
    "backfill_resume": f"""WITH {_BF} SELECT run_id, page_number, count(*) AS n FROM p WHERE page_number >= 2 AND (ats IS NULL OR ats BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-12-01') GROUP BY 1, 2""",
    "freshness": f"""WITH {RUNS_CTE}, q AS (SELECT max(finished_at) FILTER (status = 'success') AS last, arg_max(new_count, (finished_at, run_id)) FILTER (status = 'success') AS n, count(*) FILTER (status = 'running') AS r FROM runs)
        SELECT {_T('last')} AS last_successful_update, n AS last_new_count, r AS running_count, r > 0 AS is_updating,
          CAST(floor((epoch_us(TIMESTAMP '2024-01-31 01:30:00') - epoch_us(last)) / 60000000) AS BIGINT) AS data_delay_minutes,
          CASE WHEN last IS NULL THEN 'unknown' WHEN floor((epoch_us(TIMESTAMP '2024-01-31 01:30:00') - epoch_us(last)) / 60000000) <= 180 THEN 'healthy' ELSE 'delayed' END AS delay_status FROM q""",
    "batch_progress": f"""WITH {RUNS_CTE}, i AS (SELECT source_name % 10 AS batch_id, CAST(source_name AS VARCHAR) AS source_name, run_id, new_count, updated_count, duplicate_count,
            CASE WHEN source_name % 10 > 6 THEN 'success' ELSE ['success', 'empty', 'failed', 'skipped', 'running', 'success', 'cancelled'][run_id % 7 + 1] END AS status FROM runs),
          b AS (SELECT batch_id, count(*) AS item_count, count(*) FILTER (status <> 'running') AS completed_count, count(*) FILTER (status = 'failed') AS failed_count,
            count(*) FILTER (status IN ('skipped', 'cancelled')) AS skipped_count, min(source_name) FILTER (status = 'running') AS first_current, count(*) FILTER (status = 'running') AS running_count,
            CAST(sum(new_count) AS BIGINT) AS new_count, CAST(sum(updated_count) AS BIGINT) AS updated_count, CAST(sum(duplicate_count) AS BIGINT) AS duplicate_count FROM i GROUP BY 1)
        SELECT batch_id, CASE WHEN completed_count < item_count THEN 'running' WHEN batch_id = 8 THEN 'cancelled' WHEN failed_count > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status,
          item_count, completed_count, failed_count, skipped_count, first_current, running_count, item_count - completed_count AS remaining, new_count, updated_count, duplicate_count FROM b""",
    "work_list": f"WITH {SOURCES_CTE} SELECT source_name, CASE WHEN runnable THEN 'queued' ELSE 'skipped' END AS status, CASE WHEN NOT runnable THEN adapter_status || '/' || crawl_method END AS skip_reason FROM ok",
    "overdue_sources": f"WITH {SOURCES_CTE} SELECT source_name, {_T('ok.next_run_at')} AS next_run_at FROM ok WHERE runnable AND ok.next_run_at <= TIMESTAMP '2024-01-31 01:30:00' ORDER BY ok.next_run_at, source_name LIMIT 50",
    "gap_report": f"WITH {SOURCES_CTE} SELECT source_name, CASE WHEN k % 4 = 0 THEN 'already_active' ELSE 'queued' END AS decision FROM src WHERE adapter_status = 'active' AND backfill_enabled",
    "source_attributes": f"""WITH {SOURCES_CTE} SELECT source_name,
        CAST(CASE WHEN crawl_method = 'manual_import' THEN NULL WHEN source_type = 'media' THEN 30 WHEN source_type = 'official' THEN 180 WHEN source_type = 'procurement' THEN 240 WHEN source_type IN ('chamber', 'policy') THEN 720 ELSE 1440 END AS BIGINT) AS schedule_minutes,
        CASE WHEN crawl_method = 'manual_import' OR source_type = 'manual' THEN 'manual_only' WHEN NOT enabled THEN 'disabled' WHEN contains(lower(notes), 'paid') THEN 'blocked' WHEN k % 4 = 0 THEN 'blocked' WHEN k % 2 = 0 THEN 'active' ELSE 'pending_adapter' END AS adapter_status,
        array_to_string(list_sort(list_filter([CASE WHEN source_type = 'official' THEN 'official_owner' END, CASE WHEN nation < 5 THEN 'governed' END, CASE WHEN source_type = 'manual' THEN 'manual_only' END], lambda x: x IS NOT NULL)), '|') AS tags FROM src""",
    "next_runs": f"WITH {SOURCES_CTE} SELECT source_name, {_T('next_run_at + to_minutes(CASE WHEN minutes = 0 THEN 1440 ELSE minutes END)')} AS next_run FROM src",
    "source_health": f"""WITH {SOURCES_CTE} SELECT count(*) FILTER (enabled AND consecutive_failures > 0) AS failed_sources, count(*) FILTER (backfill_status = 'completed') AS backfill_completed,
        count(*) FILTER (backfill_enabled AND backfill_status NOT IN ('completed', 'unsupported')) AS backfill_pending, count(*) FILTER (NOT backfill_enabled OR backfill_status = 'unsupported') AS backfill_unsupported FROM src""",
    "source_list": f"""WITH {RUNS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, run_id DESC) AS rn FROM runs)
        SELECT c_custkey AS source_name, coalesce(status, 'never') AS latest_status, coalesce(fetched_count, 0) AS latest_fetched, coalesce(new_count, 0) AS latest_new,
          coalesce(greatest(0, fetched_count - new_count - updated_count - duplicate_count), 0) AS latest_skipped FROM customer LEFT JOIN r ON r.source_name = c_custkey AND rn = 1""",
    "catalog_upsert": f"""WITH {SOURCES_CTE}, j AS (SELECT *, k % 10 <> 0 AS stored, k % 10 <> 9 AS incoming, CASE WHEN k % 3 = 0 THEN 'active' ELSE 'disabled' END AS want FROM src),
        q AS (SELECT *, CASE WHEN stored AND adapter_status = 'paused' AND consecutive_failures >= 5 AND want = 'active' THEN 'paused' ELSE want END AS st,
          CASE WHEN NOT stored OR (adapter_status IN ('pending_adapter', 'disabled') AND want = 'active') THEN TRUE ELSE enabled END AS en FROM j)
        SELECT source_name, CASE WHEN incoming THEN 'renewed' ELSE source_type END AS source_type, CASE WHEN incoming THEN st ELSE adapter_status END AS adapter_status, CASE WHEN incoming THEN en ELSE enabled END AS enabled,
          CAST(CASE WHEN NOT incoming THEN nullif(minutes, 0) WHEN stored THEN coalesce(nullif(minutes, 0), 99) ELSE 99 END AS BIGINT) AS schedule_minutes,
          CASE WHEN incoming AND (NOT stored OR backfill_status = 'not_started') THEN TRUE ELSE backfill_enabled END AS backfill_enabled,
          CASE WHEN NOT incoming THEN {_T('q.next_run_at')} WHEN st NOT IN ('active', 'paused') THEN NULL WHEN stored THEN {_T('q.next_run_at')} WHEN st = 'active' THEN '2024-02-01 00:00:00' END AS next_run_at FROM q""",
}
