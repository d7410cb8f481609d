"""Review state folded from append-only logs (M4-M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.skew import first_per_key, split_lag

# The state each review action leads to.
ARTICLE_STATES = {"approve": "approved", "reject": "rejected", "needs_changes": "needs_changes"}
CHANGE_STATES = {"approve": "verified", "reject": "rejected", "needs_changes": "pending_review"}


def fold_reviews(rows: DataFrame, log: DataFrame, row_id: str, states: dict[str, str], column: str, seq: str = "review_id") -> DataFrame:
    """M4, M5: the latest action of each row decides its state; rows without one keep theirs."""
    last = first_per_key(log, [row_id], [-F.unix_micros("created_at"), -F.col(seq)], ["action"])
    names = F.create_map(*[x for k, v in states.items() for x in (F.lit(k), F.lit(v))])
    out = rows.join(last, row_id, "left")
    return out.withColumn(column, F.coalesce(F.element_at(names, F.col("action")), F.col(column))).drop("action")


def review_history(log: DataFrame, row_id: str, states: dict[str, str], initial: str = "pending", seq: str = "review_id") -> DataFrame:
    """M4: before and after state of every review record; the look-back is split by day."""
    names = F.create_map(*[x for k, v in states.items() for x in (F.lit(k), F.lit(v))])
    after = log.withColumn("after_state", F.element_at(names, F.col("action")))
    seen = split_lag(after, row_id, ["created_at", seq], ["after_state"], F.to_date("created_at"))
    return seen.withColumn("before_state", F.coalesce("prev_after_state", F.lit(initial))).drop("prev_after_state")


def audit_tail(log: DataFrame, n: int = 100, seq: str = "audit_id") -> DataFrame:
    """M6: newest audit rows (top-k, never a full sort)."""
    return log.orderBy(F.desc("created_at"), F.desc(seq)).limit(n)
