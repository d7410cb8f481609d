"""The query catalogue keeps the driver contract."""

import re

import __spark_entry__ as entry
import duckdb
import pytest

from check_oracle import TABLES, rows_of

SAMPLE = ["canonical_url", "tag_gate", "relevance_score", "event_key", "failure_streak", "changed_lines", "import_split", "reconcile_entities"]


def test_every_query_has_a_callable_and_sql_names_only_known_queries():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) > 100 and set(sql) <= set(qs)
    own = {n for n in qs if not re.match(r"op\d+_|pipeline$", n)}
    assert own - set(sql) == {"ingest_cascade_sequence"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())
