"""Joins of the query surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.skew import counted_broadcast

MAX_CHILDREN = 1000


def detail_with_article(details: DataFrame, articles: DataFrame, article_columns: Sequence[str], key: str = "article_id") -> DataFrame:
    """policy or leader rows with chosen article columns; filters on both sides push down."""
    return details.join(articles.select(key, *article_columns), key)


def nest_children(
    parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], name: str, max_children: int = MAX_CHILDREN
) -> tuple[DataFrame, DataFrame]:
    """parents with a sorted array of their children, and the children of wide parents as rows.

    Children are counted first (combined on the map side).  Parents with at most ``max_children``
    get an array (empty when they have none); the children of the others stay rows, so no task
    ever holds an unbounded list and no child is lost.
    """
    sizes = children.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    wide = sizes.filter(F.col("_n") > max_children).select(key)
    narrow = children.join(wide, key, "left_anti")
    nested = narrow.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(wide, key, "left_anti").join(nested, key, "left")
    out = out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    rows = parents.join(wide, key, "left_semi").join(children.select(key, *[c for c in fields if c != key]), key)
    return out, rows


def members_of(df: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """F8: rows whose key is in a set."""
    return df.join(counted_broadcast(names.select(on).distinct()), on, "left_semi")


def absent_from(df: DataFrame, ledger: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in a ledger."""
    return df.join(ledger.select(*on).distinct(), list(on), "left_anti")


def struct_by_name(arr: Column, field: str, value: Column) -> Column:
    """K5: the first struct whose field equals a value."""
    return F.get(F.filter(arr, lambda x: x[field] == value), F.lit(0))
