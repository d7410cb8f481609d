"""Incremental jobs.

Each job is written so that the same input gives the same result in batch: the streaming tests
compare both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.changes import change_records
from newsloom.operators.dedup import ingest_cascade

STREAK_SCHEMA = "source_name string, consecutive_failures bigint, paused boolean"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file source."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def first_seen(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """L2: drop repeats of a key that arrive within the watermark (bounded state)."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def trailing_counts(stream: DataFrame, at: str, keys: list[str], width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Event-time window counts per key; rows later than ``delay`` are dropped by the watermark."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    grouped = stream.withWatermark(at, delay).groupBy(w.alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def ingest_stream(
    stream: DataFrame, state_path: str, checkpoint: str, as_of: datetime, prepare: Callable[[DataFrame], DataFrame], measure: str = "edit"
):
    """L1: run the cascade on each micro-batch against the articles accepted so far.

    ``prepare`` maps raw items to the cascade columns.  Every batch writes its own folder under
    ``state_path``, so a batch replayed after a failure overwrites its result instead of adding it.  A new
    checkpoint over the same state goes on from all that is stored.
    """
    run = run_name(checkpoint)

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        items = prepare(batch)
        old = stored_before(spark, state_path, run, epoch)
        existing = None if old is None else old.filter("outcome = 'new'").select(*items.columns)
        out = ingest_cascade(items, as_of, measure, existing=existing)
        out.write.mode("overwrite").parquet(f"{state_path}/run={run}/epoch={epoch}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_name(checkpoint: str) -> str:
    """Name of a stream's own state folders: one per checkpoint, the same after a restart."""
    return "c" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def stored_before(spark: SparkSession, path: str, run: str, epoch: int) -> DataFrame | None:
    """What earlier batches of this run and all batches of other runs have stored; None if there is nothing."""
    try:
        old = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return old.filter((F.col("run") != run) | (F.col("epoch") < epoch))


def failure_streak_stream(stream: DataFrame, state_path: str, checkpoint: str, pause_after: int = 5):
    """Failures since the last success, kept per source as runs arrive.

    ``stream``: source_name, ``mark`` (bigint order of the run) and ``failed``.  A batch is reduced to a few numbers per
    source by built-in aggregates, combined on the map side, and merged with the state the batch before it left (one
    row per source).  Batches of a source must arrive in order; inside a batch the order is free.
    """
    run = run_name(checkpoint)

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ok = batch.groupBy("source_name").agg(F.max(F.when(~F.col("failed"), F.col("mark"))).alias("ok"))
        bad = batch.filter("failed").join(ok, "source_name").filter("ok is null or mark > ok").groupBy("source_name").agg(F.count(F.lit(1)).alias("bad"), F.max("mark").alias("newest"))
        mine = ok.join(bad, "source_name", "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
        before = stored_before(spark, state_path, run, epoch)
        if before is not None:
            last = before.agg(F.max(F.struct("epoch", "run"))).first()[0]
            before = before.filter((F.col("epoch") == last["epoch"]) & (F.col("run") == last["run"])) if last else None
        if before is None:
            before = spark.createDataFrame([], "source_name string, last_ok bigint, open_count bigint")
        both = before.select("source_name", "last_ok", "open_count").join(mine, "source_name", "full")
        state = both.select(
            "source_name", F.greatest("last_ok", "ok").alias("last_ok"),
            (F.col("bad") + F.when(F.col("ok").isNull(), F.coalesce("open_count", F.lit(0))).otherwise(0)).alias("_new"), "open_count",
        ).select("source_name", "last_ok", F.coalesce("_new", "open_count").cast("bigint").alias("open_count"))
        state = state.withColumns({"consecutive_failures": F.col("open_count"), "paused": F.col("open_count") >= pause_after})
        state.write.mode("overwrite").parquet(f"{state_path}/run={run}/epoch={epoch}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def failure_streaks(runs: DataFrame, source: str = "source_name", pause_after: int = 5) -> DataFrame:
    """L5 as a stateful operator, for streams that need no stored state.

    Columns: source, ``mark`` (bigint order of the run) and ``failed``.  State is two numbers per
    source: the newest success and the open failures after it.  Batches of a source must arrive in
    order; inside a batch the order is free, and only open failure marks are held.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ok, open_count = state.get if state.exists else (-1, 0)
        last, marks = ok, np.empty(0, dtype="int64")
        for frame in batches:
            good = frame.loc[~frame["failed"], "mark"]
            last = max(last, int(good.max())) if len(good) else last
            marks = np.concatenate([marks, frame.loc[frame["failed"], "mark"].to_numpy("int64")])
            marks = marks[marks > last]
        open_count = len(marks) + (open_count if last == ok else 0)
        state.update((last, open_count))
        yield pd.DataFrame({"source_name": [key[0]], "consecutive_failures": [open_count], "paused": [open_count >= pause_after]})

    return runs.groupBy(source).applyInPandasWithState(
        update, STREAK_SCHEMA, "last_ok bigint, open_count bigint", "update", GroupStateTimeout.NoTimeout
    )


def ledger_dedup_stream(stream: DataFrame, key: str, ledger_path: str, checkpoint: str, prefix: int = 1):
    """L2: rows whose digest ``key`` no earlier batch has; the digests live in a ledger of files, not in memory.

    The ledger is partitioned by the first characters of the digest, and a batch reads only the parts that its own
    digests fall into.  State grows on disk alone, and no digest is ever forgotten.
    """
    run = run_name(checkpoint)

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("prefix", F.concat(F.lit("p"), F.substring(key, 1, prefix)))
        old = stored_before(spark, ledger_path, run, epoch)
        if old is not None:
            parts = [r[0] for r in fresh.select("prefix").distinct().collect()]  # at most 16 ** prefix
            fresh = fresh.join(old.filter(F.col("prefix").isin(parts)).select("prefix", key), ["prefix", key], "left_anti")
        fresh.write.mode("overwrite").partitionBy("prefix").parquet(f"{ledger_path}/run={run}/epoch={epoch}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def page_change_stream(stream: DataFrame, state_path: str, checkpoint: str, roles: tuple[str, ...] = (), org_words: tuple[str, ...] = ()):
    """L4: change records of landed page versions against the newest stored version of each address.

    ``stream``: url, captured_at, text.  Stores one folder per batch with all new versions.
    """
    run = run_name(checkpoint)

    def handle(batch: DataFrame, epoch: int) -> None:
        from newsloom.operators.changes import page_versions

        spark = batch.sparkSession
        rows = batch.select("url", "captured_at", "text", F.lit(False).alias("stored"))
        past = stored_before(spark, f"{state_path}/versions", run, epoch)
        if past is not None:
            past = past.join(batch.select("url").distinct(), "url", "left_semi")
            latest = past.groupBy("url").agg(F.max_by(F.struct("captured_at", "text"), "captured_at").alias("v"))
            rows = rows.unionByName(latest.select("url", "v.captured_at", "v.text", F.lit(True).alias("stored")))
        versions = page_versions(rows, "url", "captured_at", "text", F.to_date("captured_at"))
        fresh = versions.filter(~F.col("stored"))
        fresh.select("url", "captured_at", "text").write.mode("overwrite").parquet(f"{state_path}/versions/run={run}/epoch={epoch}")
        change_records(fresh, "text", roles, org_words).write.mode("overwrite").parquet(f"{state_path}/changes/run={run}/epoch={epoch}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def undated_side_output(df: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Dated rows, and the undated rows kept apart from time-based statistics."""
    return df.filter(F.col(at).isNotNull()), df.filter(F.col(at).isNull())


def backfill_window(rows: DataFrame, start: datetime, end: datetime, done: DataFrame | None = None) -> DataFrame:
    """L3: landed backfill pages to ingest: no page already in the checkpoint ledger, no page after the
    one that reached the start date, dated rows inside the range, undated rows kept.

    ``rows``: run_id, page_number, published_at and the item columns.
    """
    at: Column = F.col("published_at")
    stop = rows.filter(at < F.lit(start)).groupBy("run_id").agg(F.min("page_number").alias("_stop"))
    open_rows = rows.join(stop, "run_id", "left").filter(F.col("_stop").isNull() | (F.col("page_number") <= F.col("_stop"))).drop("_stop")
    if done is not None:
        open_rows = open_rows.join(done.select("run_id", "page_number").distinct(), ["run_id", "page_number"], "left_anti")
    return open_rows.filter(at.isNull() | ((at >= F.lit(start)) & (at <= F.lit(end))))


def checkpoint_rows(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """L3: one checkpoint row per page, for the ledger."""
    return rows.groupBy("run_id", "page_number").agg(F.count(F.lit(1)).alias("fetched_count"), F.min("published_at").alias("oldest_published_at"))
