from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.operators import changes, dedup, entities, health, reviews, search, stats
from newsloom.skew import keyed_lookup, split_lag

AS_OF = datetime(2025, 3, 1, tzinfo=timezone.utc)
DDL = "id int, title string, summary string, content_excerpt string, country string, region string, published_at timestamp, fetched_at timestamp, is_overseas boolean, is_demo boolean"


@pytest.fixture(scope="module")
def articles(spark):
    ago = lambda n: AS_OF - timedelta(days=n)
    return spark.createDataFrame([
        (1, "Rail deal", "s", "body", "Kenya", "Africa", ago(364), AS_OF, True, False),
        (2, "Old deal", "s", "body", "Chile", "Latin America", ago(366), AS_OF, True, False),
        (3, "Undated deal", "s", "100% body", "Kenya", "Africa", None, AS_OF, True, False),
        (4, "Demo", "s", "body", "Kenya", "Africa", ago(1), AS_OF, True, True),
    ], DDL)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_window_and_archive(articles):
    assert ids(search.apply_filters(articles, search.FilterSpec(), AS_OF)) == [1]
    assert ids(search.apply_filters(articles, search.FilterSpec(include_archive=True), AS_OF)) == [1, 2, 3]
    assert ids(search.apply_filters(articles, search.FilterSpec(include_archive=True, country="Kenya", q="DEAL"), AS_OF)) == [1, 3]
    assert ids(search.apply_filters(articles, search.FilterSpec(include_archive=True, q="0%"), AS_OF)) == [3]
    assert ids(search.apply_filters(articles, search.FilterSpec(include_archive=True, q="rail body", search="fulltext"), AS_OF)) == [1]


def test_bad_arguments(articles):
    with pytest.raises(ValueError):
        search.article_order("random")
    with pytest.raises(ValueError):
        search.page(articles, search.article_order("published_asc"), 0)
    with pytest.raises(ValueError):
        search.board_filters(articles, search.BoardSpec(band="top"), "id")
    with pytest.raises(ValueError):
        search.apply_filters(articles, search.FilterSpec(date_from="March"), AS_OF)


def test_paging_is_stable(articles):
    spec = search.FilterSpec(include_archive=True)
    one, total = search.search_articles(articles, spec, AS_OF, 1, 2)
    two, _ = search.search_articles(articles, spec, AS_OF, 2, 2)
    assert [r.id for r in one.collect()] == [3, 1] and [r.id for r in two.collect()] == [2] and total.collect()[0].total == 3


def test_page_after_equals_offset(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 7 / 10).alias("confidence_score"), F.lit(None).cast("timestamp").alias("published_at"), F.timestamp_seconds(F.col("id") % 5).alias("fetched_at"))
    for sort, value in (("published_desc", "fetched_at"), ("published_asc", "fetched_at"), ("confidence_desc", "confidence_score")):
        last = search.page(df, search.article_order(sort), 1, 15).collect()[-1]
        want = [r.id for r in search.page(df, search.article_order(sort), 2, 15).collect()]
        assert [r.id for r in search.page_after(df, sort, last[value], last.id, 15).collect()] == want


def test_equality_filters_reach_the_scan(spark, articles, tmp_path, capsys):
    articles.write.parquet(str(tmp_path / "a"))
    df = search.apply_filters(spark.read.parquet(str(tmp_path / "a")), search.FilterSpec(country="Kenya"), AS_OF).select("id")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(country,Kenya)" in plan and "content_excerpt" not in plan


def test_hot_key_lookup_is_complete(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    for weight in ("n", None):
        out = keyed_lookup(rows, table, ["k"], "id", weight=weight, hot_rows=20)
        assert out.count() == 1000 and out.filter("k = 'hot' and first = 0").count() == 334


def test_rows_without_a_key_survive_the_lookup(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 != 0, (F.col("id") % 5).cast("string")).alias("k"))
    out = keyed_lookup(rows, rows.filter("k is not null").groupBy("k").agg(F.min("id").alias("first")), ["k"], "id", hot_rows=10)
    assert out.count() == 300 and out.filter("k is null and first is null").count() == 100 and out.filter("k is not null and first is null").count() == 0


def test_split_lag_equals_lag(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v"))
    got = {(r.k, r.o): r.prev_v for r in split_lag(df, "k", ["o"], ["v"], F.floor(F.col("o") / 17)).collect()}
    last, want = {}, {}
    for i in range(200):
        want[(i % 3, i)] = last.get(i % 3)
        last[i % 3] = i * 7 % 11
    assert got == want


def test_versions_and_changes(spark):
    rows = [("u", 1, "a\nb"), ("u", 2, "a\nb"), ("u", 3, "a\nDirector c"), ("w", 1, "x")]
    v = changes.page_versions(spark.createDataFrame(rows, "url string, at int, text string"), "url", "at", "text", F.col("at"))
    assert sorted((r.url, r["at"]) for r in v.collect()) == [("u", 1), ("u", 3), ("w", 1)]
    c = changes.change_records(v, "text", ("Director",), ()).collect()
    assert len(c) == 1 and c[0].added_lines == ["Director c"] and c[0].removed_lines == ["b"] and c[0].detected_changes[0].kind == "leadership_or_title"
    assert c[0].verification_status == "pending_review"


def test_streak_and_work_list(spark):
    t = lambda m: AS_OF + timedelta(minutes=m)
    runs = spark.createDataFrame([("a", 1, t(1), False), ("a", 2, t(2), True), ("a", 3, t(3), True), ("b", 4, t(1), True), ("c", 5, t(1), True), ("c", 6, t(2), False)], "s string, r int, t timestamp, f boolean")
    got = {x.s: x.consecutive_failures for x in health.failure_streak(runs, "s", "t", "r", F.col("f")).collect()}
    assert got == {"a": 2, "b": 1, "c": 0}
    src = spark.createDataFrame([("a", True, "active", "rss", "media"), ("b", True, "paused", "rss", "media"), ("c", True, "active", "manual_import", "media")], "source_name string, enabled boolean, adapter_status string, crawl_method string, source_type string")
    assert {(r.source_name, r.status, r.skip_reason) for r in health.work_list(src).collect()} == {("a", "queued", None), ("b", "skipped", "paused/rss"), ("c", "skipped", "active/manual_import")}


def test_entities_match_exactly(spark):
    master = spark.createDataFrame([("p1", "Harbour Works", "HW", ["H-W Group"]), ("p2", "Harbour Services", "HS", ["Port A"]), ("p3", "Harbor Works", None, ["Port A"])], "entity_id string, canonical_name string, short_name string, aliases array<string>")
    names = spark.createDataFrame([(1, "harbour works"), (2, "HW Group"), (3, "Harbour"), (4, "Port A"), (5, " HS ")], "i int, n string")
    assert {r.i: r.entity_id for r in entities.resolve_names(names, "n", master, "i").collect()} == {1: "p1", 2: "p1", 3: None, 4: None, 5: "p2"}
    with pytest.raises(ValueError):
        entities.load_master(master, ["entity_id", "stock_code"])
    with pytest.raises(ValueError):
        entities.load_master(master.unionByName(master), ["entity_id", "canonical_name", "short_name", "aliases"])


def test_best_per_event_and_reviews(spark):
    df = spark.createDataFrame([
        (1, "e", "h1", "medium", False, 90, AS_OF), (2, "e", "h2", "high", False, 60, AS_OF), (3, "e", "h3", "high", True, 50, AS_OF), (4, None, "h4", "low", False, 10, AS_OF),
    ], "id int, canonical_event_id string, content_hash string, reliability_level string, is_primary_source boolean, s int, published_at timestamp").withColumn("fetched_at", F.col("published_at"))
    assert ids(dedup.best_per_event(df, "id", "s")) == [3, 4]
    log = spark.createDataFrame([(1, 1, "approve", AS_OF), (2, 1, "reject", AS_OF + timedelta(days=1))], "review_id int, id int, action string, created_at timestamp")
    state = {r.id: r.st for r in reviews.fold_reviews(df.withColumn("st", F.lit("pending")), log, "id", reviews.ARTICLE_STATES, "st").collect()}
    assert state[1] == "rejected" and state[2] == "pending"


def test_ratios_of_nothing(spark):
    empty = spark.createDataFrame([], "event_identity string, x boolean")
    r = stats.with_ratios(stats.conditional_event_counts(empty, {"x": F.col("x")}), {"r": "x"}).collect()[0]
    assert (r.total, r.r) == (0, 0.0)
