"""Building blocks that stay balanced when one key holds a large share of rows.

* ``first_per_key`` replaces ``row_number() = 1`` windows: a struct ``min`` is
  combined on the map side, so a hot key ships one row per map task.
* ``keyed_lookup`` joins rows to a table with few rows per key and salts only the
  keys that are measured to be hot.
* ``split_lag`` computes ``lag`` without putting a whole key in one task.
* ``counted_broadcast`` broadcasts only after counting.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_ROWS = 500_000
NO_KEY_SALTS = 2048
BROADCAST_ROWS = 50_000


def counted_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the join to AQE."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """The first row of each key under ``order`` (end it with a unique column)."""
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    picked = F.min_by(F.struct(*columns), rank)
    return df.groupBy(*keys).agg(picked.alias("_first")).select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in columns]
    )


def keyed_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    row_id: str,
    weight: str | None = None,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` (any number per key) to ``table`` (few per key) without a hot task.

    Keys with more than ``hot_rows`` rows get ``ceil(n / hot_rows)`` salts: rows
    take a salt from their id, the table row is repeated once per salt.  At most
    ``rows / hot_rows`` keys can pass that mark, which bounds what is broadcast
    (50 billion rows give at most 100,000 short key rows).  ``weight`` names a column
    with the number of rows per key when ``table`` has one row per key; without it the keys are
    counted here.
    """
    on = list(on)
    if weight is None:
        sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    else:
        sizes = table.select(*on, F.col(weight).alias("_n"))
    hot = (
        sizes.filter(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    # Rows without a key match nothing; they are spread instead of meeting in one partition.
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    salts = F.when(no_key, NO_KEY_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_rows = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(row_id), salts).cast("int")
    ).drop("_salts")
    salted_table = table.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return salted_rows.join(salted_table, [*on, "_salt"], how).drop("_salt")


def split_lag(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], block: Column
) -> DataFrame:
    """Add ``prev_<c>`` for each column: its value in the previous row of ``key``.

    ``block`` must be non-decreasing along ``order`` (a day, a version range).  The lag
    runs inside (key, block); the first row of a block takes its value from the last
    row of the previous block, found on a table with one row per block.
    """
    blocked = df.withColumn("_blk", block)
    inner = Window.partitionBy(key, "_blk").orderBy(*order)
    here = F.struct(F.lit(True).alias("_seen"), *columns)
    lagged = blocked.withColumn("_in", F.lag(here).over(inner))
    tails = blocked.groupBy(key, "_blk").agg(F.max_by(here, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(key).orderBy("_blk")
    edges = tails.select(key, "_blk", F.lag("_tail").over(across).alias("_edge")).filter("_edge is not null")
    joined = lagged.join(edges, [key, "_blk"], "left")
    prev = F.when(F.col("_in").isNotNull(), F.col("_in")).otherwise(F.col("_edge"))
    return joined.withColumn("_prev", prev).select(
        *df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns]
    )


def split_rank(df: DataFrame, key: str, block: Column, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the place (from 1) of each row within ``key`` under ``order``, without one task per key.

    ``block`` must be non-decreasing along ``order`` (end it with a unique column): a row's place is the number of rows
    in the earlier blocks of its key plus its place in its own block.
    """
    blocked = df.withColumn("_blk", block)
    sizes = blocked.groupBy(key, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(key, "_blk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_blk").orderBy(*order))
    return blocked.withColumn("_own", own).join(before, [key, "_blk"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_blk", "_own", "_before")
