"""Plans keep their shape: no products of data tables, small scans, limits before shuffles."""

import __spark_entry__ as entry
import pytest

NO_LOOP = [
    "canonical_url", "tag_gate", "alias_candidates", "event_rollup", "events_per_region", "best_per_event", "failure_streak", "latest_run", "version_changes",
    "entity_resolution", "import_replay", "title_near_duplicates", "newest_per_source", "customer_sets",
]


def plan_of(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", NO_LOOP)
def test_no_product_of_tables(spark, sf_dir, capsys, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir), capsys)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_aggregates_read_only_their_columns(spark, sf_dir, capsys):
    plan = plan_of(entry.queries()["latest_run"](spark, sf_dir), capsys)
    assert "props" not in plan
    plan = plan_of(entry.queries()["customer_sets"](spark, sf_dir), capsys)
    assert "ReadSchema: struct<o_custkey" in plan and "o_totalprice" not in plan


def test_top_n_is_limited_before_the_shuffle(spark, sf_dir, capsys):
    plan = plan_of(entry.queries()["newest_per_source"](spark, sf_dir), capsys)
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") >= 0 and "Partial" in plan
