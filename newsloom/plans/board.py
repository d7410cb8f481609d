"""The event board: one plan, filters before limits (section 3.3 of the blueprint)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import dedup, search
from newsloom.operators.scoring import score_band


def event_board(
    articles: DataFrame, spec: search.BoardSpec, filters: search.FilterSpec, as_of: datetime,
    sources: DataFrame | None = None, row_id: str = "id",
) -> DataFrame:
    """Best row per event among the matching articles, with score, band and location scope.

    ``articles`` carry the metadata columns of ``scoring.sales_metadata``.
    """
    rows = articles.filter(~F.col("is_demo")) if "is_demo" in articles.columns else articles
    rows = search.apply_filters(rows.drop("is_overseas", "is_demo"), filters, as_of)
    rows = rows.withColumn("board_score", search.score_or_default(rows))
    rows = search.board_filters(rows, spec, "board_score", sources)
    best = dedup.best_per_event(rows, row_id, "board_score")
    return best.withColumns({
        "band": score_band(F.col("board_score")),
        "location_scope": F.when(F.col("overseas_rank") == 0, "overseas").otherwise("domestic"),
    })


def board_page(board: DataFrame, sort: str, page_no: int = 1, size: int = 50, row_id: str = "id") -> DataFrame:
    """A sorted page of the board."""
    return search.page(board, search.board_order(sort, "board_score", row_id), page_no, size)
