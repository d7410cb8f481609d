"""Page versions and change records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import contains_any
from newsloom.skew import split_lag

# How long a version is kept and how many change lines a record holds.
RETAIN_DAYS, MAX_CHANGES, LINE_CHARS = 366, 100, 500


def page_versions(pages: DataFrame, url: str, at: str, text: str, block: Column, tie: str | None = None) -> DataFrame:
    """Versions whose text differs from the previous version of the address.

    Adds ``content_sha256``, ``prev_content_sha256`` and ``prev_<text>``.  Since unchanged captures
    repeat the hash of the version before them, comparing neighbours equals comparing with the
    latest stored version.  ``block`` splits long histories (see ``skew.split_lag``).
    """
    hashed = pages.withColumn("content_sha256", F.sha2(F.coalesce(text, F.lit("")), 256))
    order = [at] + ([tie] if tie else [])
    seen = split_lag(hashed, url, order, ["content_sha256", text], block)
    return seen.filter(~F.col("content_sha256").eqNullSafe(F.col("prev_content_sha256")))


def change_records(versions: DataFrame, text: str, roles: Sequence[str] = (), org_words: Sequence[str] = ()) -> DataFrame:
    """Added and removed lines of each changed version, classified and capped as stored."""
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    changed = versions.filter(F.col("prev_content_sha256").isNotNull())
    added = F.array_sort(F.array_except(lines(F.col(text)), lines(F.col(f"prev_{text}"))))
    removed = F.array_sort(F.array_except(lines(F.col(f"prev_{text}")), lines(F.col(text))))
    kind = lambda v: F.when(contains_any(v, roles), "leadership_or_title").when(contains_any(v, org_words), "organization_or_relation")
    found = F.transform(
        F.filter("added_lines", lambda v: kind(v).isNotNull()),
        lambda v: F.struct(kind(v).alias("kind"), F.substring(v, 1, LINE_CHARS).alias("value")),
    )
    return (
        changed.withColumns({"added_lines": added, "removed_lines": removed})
        .withColumn("detected_changes", F.slice(found, 1, MAX_CHANGES))
        .withColumn("confidence", F.when((F.size("added_lines") > 0) | (F.size("removed_lines") > 0), 0.7).otherwise(0.2))
        .withColumn("verification_status", F.lit("pending_review"))
    )


def retain(versions: DataFrame, at: str, as_of: Column, days: int = RETAIN_DAYS) -> DataFrame:
    """Versions still inside their retention horizon."""
    return versions.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
