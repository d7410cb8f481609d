"""Writes: month-partitioned article tables, upserts and append-only ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import cut_lineage, drop_folder
from newsloom.skew import first_per_key

UNDATED = "undated"
KEY_BUCKETS = 32


def with_month(df: DataFrame, at: str = "published_at") -> DataFrame:
    """Partition column of the article table; undated rows get a partition of their own."""
    return df.withColumn("pub_month", F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(UNDATED)))


def write_months(df: DataFrame, path: str, mode: str = "overwrite", at: str = "published_at", files_per_month: int | None = None) -> None:
    """Write by publication month; only touched months are replaced.

    Without ``files_per_month`` AQE rebalances the rows, so a month with a third of the data is
    split over many files instead of one task.
    """
    out = with_month(df, at)
    out = out.hint("rebalance", "pub_month") if files_per_month is None else out.repartition(files_per_month, "pub_month", F.xxhash64(*[c for c in df.columns][:1]))
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("pub_month").parquet(path)


def read_months(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """Read the article table, pruned to some months."""
    df = spark.read.parquet(path)
    return df if months is None else df.filter(F.col("pub_month").isin(*months))


def upsert_months(spark: SparkSession, path: str, changes: DataFrame, key: str = "id", order: str = "arrival_seq", at: str = "published_at") -> None:
    """Upsert by key: rewrite only the months that the changes touch.

    A key must keep its publication month; a changed date is a delete plus an insert.  The last
    change of a key wins.  The new month content is materialised before the old files go.
    """
    cols = [c for c in changes.columns if c != key]
    latest = first_per_key(changes, [key], [-F.col(order)], cols)
    new = with_month(latest, at)
    touched = new.select("pub_month").distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), "pub_month", "left_semi").join(new.select(key), key, "left_anti")
    merged = cut_lineage(old.unionByName(new, allowMissingColumns=True), "upsert")
    merged.hint("rebalance", "pub_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pub_month").parquet(path)


def _key_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str = "id", at: str = "published_at") -> None:
    """Write the article table by month, and beside it the month of every key, by bucket of the key."""
    write_months(df, f"{path}/months", at=at)
    months = with_month(df.select(key, at), at).select(key, "pub_month", _key_bucket(key).alias("bucket"))
    months.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys")


def read_keyed(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    return read_months(spark, f"{path}/months", months)


def upsert_keyed(spark: SparkSession, path: str, changes: DataFrame, key: str = "id", order: str = "arrival_seq", at: str = "published_at") -> None:
    """Upsert by key, also when a row's publication month changes.

    The key table says which month holds the old row, so only the old and the new months of the changed keys are
    rewritten, and only the key buckets they fall into.  The last change of a key wins.  New content is materialised
    before old files go.
    """
    cols = [c for c in changes.columns if c != key]
    new = cut_lineage(with_month(first_per_key(changes, [key], [-F.col(order)], cols), at), "changes")
    buckets = [r[0] for r in new.select(_key_bucket(key)).distinct().collect()]  # at most KEY_BUCKETS
    known = spark.read.parquet(f"{path}/keys").filter(F.col("bucket").isin(buckets))
    held = known.join(new.select(key), key, "left_semi").select("pub_month")
    touched = [r[0] for r in held.union(new.select("pub_month")).distinct().collect()]  # one per calendar month
    old = spark.read.parquet(f"{path}/months").filter(F.col("pub_month").isin(touched)).join(new.select(key), key, "left_anti")
    merged = cut_lineage(old.unionByName(new, allowMissingColumns=True), "upsert")
    keys = cut_lineage(known.join(new.select(key), key, "left_anti").select(key, "pub_month", "bucket").unionByName(new.select(key, "pub_month", _key_bucket(key).alias("bucket"))), "keys")
    left = {r[0] for r in merged.select("pub_month").distinct().collect()}
    merged.hint("rebalance", "pub_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pub_month").parquet(f"{path}/months")
    for month in sorted(set(touched) - left):  # a month that lost its last row keeps no file
        drop_folder(spark, f"{path}/months/pub_month={month}")
    keys.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/keys")
