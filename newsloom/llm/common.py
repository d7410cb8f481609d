"""What several operators share: scratch tables, learning splits, ASCII lowering, text chunks for Arrow code."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import checkpoint_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that Arrow code handles at once; NumPy temporaries are about 60 times that at most.
CHUNK_BYTES = 2 << 20


class Scratch:
    """Tables of one run below ``spark.checkpoint.dir``.

    A written table cuts lineage, survives lost executors and can be dropped as soon as the next one exists.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(checkpoint_root(spark), "newsloom", f"{name}-{uuid.uuid4().hex}")
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{name}-{self._n}"

    def cut(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("error").options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def cut_buckets(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """``cut`` into a table that is stored by ``key``: a join on it leaves the stored rows where they are."""
        path, table_name = self.path(name), f"scratch_{uuid.uuid4().hex}"
        stored = df.repartition(buckets, key).write.mode("error").format("parquet").option("path", path)
        stored.bucketBy(buckets, key).sortBy(key).saveAsTable(table_name)
        out = self.spark.table(table_name)
        out._scratch_path, out._scratch_table = path, table_name
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for t in tables:
            if hasattr(t, "_scratch_table"):
                self.spark.sql(f"DROP TABLE IF EXISTS {t._scratch_table}")
            self._delete(t if isinstance(t, str) else t._scratch_path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def is_held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether the row is kept from learning; false for a null id."""
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is.

    ``lower`` does the same for pure ASCII (as many bytes as characters) and is much faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in ``column``, or one row that alone has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(offsets_of(batch.column(column))))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _large(array: pa.Array) -> pa.Array:
    return array.cast(pa.large_binary()) if array.type != pa.large_binary() else array


def offsets_of(array: pa.Array) -> np.ndarray:
    """Byte offsets (one more than rows) of a string or binary array."""
    array = _large(array)
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and the offsets of its rows within; null is empty."""
    array = _large(array)
    off = offsets_of(array)
    if not len(array) or array.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def rows_of(array: pa.Array) -> list[bytes]:
    """The rows of a string or binary array as bytes; null is empty."""
    return [x or b"" for x in _large(array).to_pylist()]
