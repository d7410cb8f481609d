"""Streaming forms run to completion over the given files."""

import os
import uuid

from pyspark.sql import functions as F

from newsloom.functions.text import content_digest
from newsloom.plans.showcase.base import table
from newsloom.plans.showcase.health_queries import RUNS_CTE
from newsloom.session import checkpoint_root
from newsloom.streaming import jobs


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _folder(spark, name):
    return os.path.join(checkpoint_root(spark), "newsloom-streams", f"{name}-{uuid.uuid4().hex}")


def _drain(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


BATCHES = 3


def landed_in_batches(spark, rows, order, folder, start):
    """Lands ``rows`` in three parts, each behind the other in ``order``, and runs the stream over each as one micro-batch.

    ``start`` makes the stream's writer from the landed rows.  A part has as many files as tasks write it; the checkpoint
    tells the next run which ones were read.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // BATCHES + 1
    for i in range(BATCHES):
        rows.filter(F.floor((F.col(order) - (low or 0)) / step) == i).write.mode("append").parquet(folder)
        _drain(start(jobs.file_stream(spark, folder, rows.schema)).start())


def stream_dedup(spark, sf):
    """First sighting of each content digest, against a ledger of the batches before."""
    out = _folder(spark, "dedup")
    d = table(spark, sf, "documents").select("doc_id", content_digest(F.col("text"), F.lit("")).alias("digest"))
    landed_in_batches(spark, d, "doc_id", out + "/in", lambda s: jobs.ledger_dedup_stream(s.select("digest"), "digest", out + "/t", out + "/_c"))
    return spark.read.parquet(out + "/t").select("digest")


def stream_first_seen(spark, sf):
    """First sighting of each event key within a watermark that covers all of them."""
    out = _folder(spark, "first")
    e = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    q = jobs.first_seen(e, ["event_type", "day"], "at", "1000 days").select("event_type", "day")
    _drain(q.writeStream.format("parquet").option("checkpointLocation", out + "/_c").trigger(availableNow=True).start(out + "/t"))
    return spark.read.parquet(out + "/t")


def _last_result(spark, frame, mode, name):
    """Run a stateful query; every batch overwrites the result table with the complete answer."""
    out = _folder(spark, name)
    write = lambda b, e: b.write.mode("overwrite").parquet(f"{out}/t/epoch={e}")
    _drain(frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", out + "/_c").trigger(availableNow=True).start())
    return spark.read.parquet(out + "/t")


def stream_windows(spark, sf):
    """Daily counts per event type; only the newest complete answer is kept."""
    e = _stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    res = _last_result(spark, jobs.trailing_counts(e, "at", ["event_type"], "1 day"), "complete", "windows")
    last = res.agg(F.max("epoch").alias("epoch"))
    res = res.join(F.broadcast(last), "epoch", "left_semi")
    return res.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n")


def health_state(spark, sf):
    """States of the failure streaks after each of three micro-batches."""
    out = _folder(spark, "health")
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("source_name"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("mark"), (F.col("event_type") == "error").alias("failed"))
    landed_in_batches(spark, e, "mark", out + "/in", lambda s: jobs.failure_streak_stream(s, out + "/t", out + "/_c"))
    return spark.read.parquet(out + "/t")


def stream_health(spark, sf):
    """Failure streak per source, merged batch by batch."""
    res = health_state(spark, sf)
    last = res.agg(F.max("epoch").alias("epoch"))
    return res.join(F.broadcast(last), "epoch", "left_semi").select("source_name", "consecutive_failures", "paused")


def page_states(spark, sf):
    """Change records of three micro-batches of conversation turns taken as page versions."""
    out = _folder(spark, "pages")
    p = table(spark, sf, "conversations").select("turn", F.col("conv_id").cast("string").alias("url"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("turn").cast("int"))).alias("captured_at"), "text")
    landed_in_batches(spark, p, "turn", out + "/in", lambda s: jobs.page_change_stream(s.drop("turn"), out + "/s", out + "/_c"))
    return spark.read.parquet(out + "/s/changes")


def stream_page_changes(spark, sf):
    """Change records of conversation turns taken as page versions."""
    c = page_states(spark, sf)
    return c.select("url", F.date_format("captured_at", "yyyy-MM-dd").alias("captured_at"), F.size("added_lines").cast("bigint").alias("added"), F.size("removed_lines").cast("bigint").alias("removed"))


QUERIES = {"stream_dedup": stream_dedup, "stream_first_seen": stream_first_seen, "stream_windows": stream_windows, "stream_health": stream_health, "stream_page_changes": stream_page_changes}

_DIFF = lambda a, b: f"len(list_distinct(list_filter(string_split({a}, chr(10)), lambda x: NOT list_contains(string_split({b}, chr(10)), x))))"

ORACLE = {
    "stream_first_seen": "SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "stream_dedup": "SELECT DISTINCT sha256(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g'))) AS digest FROM documents",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_health": f"""WITH {RUNS_CTE}, r AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_name ORDER BY started_at, run_id) AS island FROM runs),
        m AS (SELECT source_name, max(island) AS last FROM r GROUP BY 1)
        SELECT CAST(source_name AS VARCHAR) AS source_name, CAST(count(*) FILTER (status = 'failed' AND island = last) AS BIGINT) AS consecutive_failures, count(*) FILTER (status = 'failed' AND island = last) >= 5 AS paused FROM r JOIN m USING (source_name) GROUP BY 1""",
    "stream_page_changes": f"""WITH w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM conversations)
        SELECT CAST(conv_id AS VARCHAR) AS url, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(turn AS INTEGER)), '%Y-%m-%d') AS captured_at, CAST({_DIFF('text', 'pt')} AS BIGINT) AS added, CAST({_DIFF('pt', 'text')} AS BIGINT) AS removed
        FROM w WHERE pt IS NOT NULL AND pt <> text""",
}
