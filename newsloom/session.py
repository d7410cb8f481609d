"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC, AQE, skew handling).

    Cluster sizing (executors, memory, shuffle partitions) is left to the
    deployment: anything passed in ``conf`` or by spark-submit wins.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session
    without that setting (tests, laptops) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="newsloom-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    A written table survives the loss of any executor, is column-prunable and
    answers ``count()`` from its footers, which the iterative operators use as
    their stop test.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), "newsloom", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_spent(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more, and those that one is ``_made_of``; others are left alone."""
    for t in tables:
        drop_spent(*getattr(t, "_made_of", ()))
        if getattr(t, "_scratch_path", None):
            drop_folder(t.sparkSession, t._scratch_path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it has ended, not when the driver's memory is next collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
