"""Exact deduplication by a stateful stream with disk-backed keyed state (native).

Each document becomes a fingerprint record (digest of the normalised text, identifier, content locator). A
stream aggregates the records by digest; its state lives in RocksDB under the checkpoint, never expires, and
keeps per digest the record that stays and the number of records. Partial aggregation runs before the shuffle,
so a text that makes up a third of all rows reaches its state row as one record per task.

A digest seen more than once is a hit: the full normalised text of each of its rows is compared with the text
behind the kept locator. Rows whose bytes differ (a digest collision) are grouped again by the text itself.

Defined results: null text is the empty text; two empty texts are equal. Of equal texts the largest ``doc_id``
stays (a null id is smaller than any); among repeated rows of that id, the one with the largest locator stays.
An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, ascii_lower, fresh

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Otherwise each store reserves several MB, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def as_files(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` if it is a scan of files, else the table it is landed in, so that its rows have a place."""
    try:
        docs.select(docs.metadataColumn("_metadata").getField("row_index"))
        return docs
    except AnalysisException:
        return scratch.cut(docs, "landed")


def locator(docs: DataFrame) -> Column:
    """Struct (file, row) that finds a row's content again."""
    place = docs.metadataColumn("_metadata")
    return F.struct(place.getField("file_path").alias("file"), place.getField("row_index").alias("row"))


@contextmanager
def disk_backed_state(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(records: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stream ``records`` (digest, record) to its present end; return its state (digest, keep, n).

    Running it again with the same ``checkpoint`` and more files continues from the stored state.
    """
    states = records.groupBy("digest").agg(F.max("record").alias("keep"), F.count(F.lit(1)).alias("n"))
    sink = states.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start().awaitTermination()
    stored = records.sparkSession.read.format("statestore").load(checkpoint)
    keep, n = stored.schema["value"].dataType.names
    return stored.select("key.digest", F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{n}`").alias("n"))


def deduplicate(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256_digest,
    files_per_trigger: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, locator, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    docs = as_files(docs.select("doc_id", "text"), scratch)
    norm = normalised(F.col("text"))
    located = docs.select(F.struct("doc_id", locator(docs).alias("locator")).alias("record"), norm.alias("norm"))
    feed = scratch.cut(
        located.select(digest(F.col("norm")).alias("digest"), "record", sha256_digest(F.col("norm")).alias("text_sha256")), "feed"
    )
    checkpoint = scratch.path("state")
    if feed.isEmpty():
        state = feed.select("digest", F.col("record").alias("keep"), F.lit(0).cast("long").alias("n"))
    else:
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(feed._scratch_path)
        with disk_backed_state(spark):
            state = scratch.cut(keyed_state(stream.select("digest", "record"), checkpoint), "states")

    def told(rows: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(states, keys).select(
            "record.doc_id", "record.locator", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("record") == F.col("keep")).alias("kept"), "text_sha256",
        )

    # Full bytes on hits: hit texts once, next to the text of the record that stays.
    hits = scratch.cut(located.withColumn("digest", digest(F.col("norm"))).join(state.filter("n > 1"), "digest"), "hits")
    keepers = hits.filter(F.col("record") == F.col("keep")).select("digest", F.col("norm").alias("kept_norm"))
    unequal = scratch.cut(hits.join(keepers, "digest").filter("norm != kept_norm").select("digest"), "unequal")
    if unequal.isEmpty():
        scratch.drop(hits)
        return told(feed, state, ["digest"])
    apart = hits.join(unequal, "digest", "left_semi").select("norm", "record", sha256_digest(F.col("norm")).alias("text_sha256"))
    by_text = apart.groupBy("norm").agg(F.max("record").alias("keep"), F.count(F.lit(1)).alias("n"))
    return told(feed.join(unequal, "digest", "left_anti"), state, ["digest"]).unionByName(told(apart, by_text, ["norm"]))


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that exact deduplication drops, columns unchanged."""
    docs = as_files(docs, Scratch(docs.sparkSession, "exact-drop"))
    columns, place = [F.col(f"`{c}`") for c in docs.columns], fresh(docs, "locator")
    gone = deduplicate(docs, **options).filter("not kept").select(F.col("locator").alias(place))
    return docs.select(*columns, locator(docs).alias(place)).join(gone, place, "left_anti").select(*columns)
