"""Full ingest and the streaming jobs against their batch forms."""

from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import changes, health
from newsloom.operators.dedup import ingest_cascade
from newsloom.operators.governance import GovernanceRules
from newsloom.plans.ingest import IngestConfig, ingest
from newsloom.rules import Alias, EventRule, Gazetteer, RelevanceRules, rule_list
from newsloom.streaming import jobs

AS_OF = datetime(2025, 3, 1, tzinfo=timezone.utc)
CONFIG = IngestConfig(
    gazetteer=Gazetteer((("Kenya", "Africa", ("Kenya",)), ("Chile", "Latin America", ("Chile", "智利"))), ("overseas",)),
    aliases=(Alias("Acme", "Acme Build", "strong"), Alias("Acme", "雅建集团股份", "strong")), company_context=("company",), overseas_context=("overseas",),
    labels=rule_list([("rail", ("rail", "铁路")), ("tax", ("tax",))]), project_labels=("rail",), actions=rule_list([("award", ("wins", "中标"))]),
    relevance=RelevanceRules(entities=(("Acme", "acme"),)), official_types=("official",), own_types=("official",), governed_tag="governed",
)


def sources(spark):
    rows = [("Wire", "media", "medium", [], []), ("Ministry", "official", "high", [], []), ("Chile Daily", "media", "low", ["Chile"], [])]
    return spark.createDataFrame(rows, "source_name string, source_type string, reliability_level string, country_focus array<string>, source_tags array<string>").withColumns({
        "region_focus": F.array().cast("array<string>"), "industry_focus": F.array().cast("array<string>"), "entity_id": F.lit(None).cast("string")})


def items(spark, rows):
    day = lambda d: AS_OF - timedelta(days=d)
    return spark.createDataFrame([(i, s, t, u, day(d), None, x, "en", False) for i, (s, t, u, d, x) in enumerate(rows)], schemas.ITEMS)


def test_new_duplicate_and_promotion(spark):
    out = ingest(items(spark, [
        ("Wire", "Acme Build wins Kenya rail contract", "https://w.example/1?utm_source=a", 9, "Rail line in Kenya"),
        ("Wire", "Acme Build wins Kenya rail contract", "https://w.example/1", 9, "Rail line in Kenya"),
        ("Ministry", "Kenya rail: Acme Build wins the big deal", "https://m.example/9", 8, "Official notice"),
        ("Wire", "Local football results tonight", "https://w.example/2", 8, "sport"),
        ("Chile Daily", "Market closes higher on Friday", "https://c.example/3", 8, "numbers"),
    ]), sources(spark), CONFIG, AS_OF)
    got = {r.arrival_seq: (r.outcome, r.match_method, r.leader_seq) for r in out["outcomes"].collect()}
    assert got == {0: ("new", None, None), 1: ("updated", "canonical_url", 0), 2: ("duplicate", "canonical_event", 0), 3: ("skipped", None, None), 4: ("new", None, None)}
    a = {r.article_id: r for r in out["articles"].collect()}
    assert set(a) == {0, 4} and a[0].is_primary_source and a[0].source_name == "Ministry" and a[0].reliability_level == "high" and a[0].cross_source_count == 2
    assert not a[4].is_primary_source and a[4].verification_status == "unverified" and a[4].country == "Chile"
    e = {r.article_id: r for r in out["events"].collect()}
    assert (e[0].source_count, e[0].official_source_count, e[0].verification_status) == (2, 1, "cross_verified")
    assert [r.event_count for r in out["projects"].collect()] == [1] and out["duplicates"].count() == 1
    # fetched = new + updated + duplicate + skipped
    assert out["outcomes"].count() == 5


FEED = [
    ("Wire", "Acme Build wins Kenya rail contract", "https://w.example/1", 9, "Rail line in Kenya"),
    ("Chile Daily", "Market closes higher on Friday", "https://c.example/3", 8, "numbers"),
    ("Wire", "Tax rule changes in Kenya next year", "https://w.example/5", 8, "tax in Kenya"),
    ("Ministry", "Kenya rail: Acme Build wins the big deal", "https://m.example/9", 8, "Official notice"),
    ("Chile Daily", "Acme Build wins Kenya rail contract", "https://w.example/1", 9, "Rail line in Kenya"),
    ("Wire", "Acme Build wins another Kenya rail job worth 5 million", "https://w.example/7", 3, "rail in Kenya"),
    ("Wire", "Local football results tonight", "https://w.example/2", 8, "sport"),
]


def upserted(old, new, key):
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new)


def test_two_batches_equal_one(spark):
    every = items(spark, FEED)
    whole = ingest(every, sources(spark), CONFIG, AS_OF)
    first = ingest(every.filter("arrival_seq < 3"), sources(spark), CONFIG, AS_OF)
    second = ingest(every.filter("arrival_seq >= 3"), sources(spark), CONFIG, AS_OF, first)
    assert {r.article_id for r in second["articles"].collect()} == {0, 5}
    for name, key in (("articles", "article_id"), ("events", "article_id"), ("projects", "project_key")):
        got, want = (df.select(sorted(whole[name].columns)).collect() for df in (upserted(first[name], second[name], key), whole[name]))
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
    for name in ("outcomes", "evidence", "event_sources", "duplicates"):
        got, want = (df.select(sorted(whole[name].columns)).collect() for df in (first[name].unionByName(second[name]), whole[name]))
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name


def test_two_sources_of_one_address_count_for_the_event(spark):
    out = ingest(items(spark, [FEED[0], FEED[4]]), sources(spark), CONFIG, AS_OF)
    event = out["events"].first()
    assert (event.source_count, event.company_name, event.event_type) == (2, "Acme", "award")
    assert out["evidence"].count() == 1 and out["articles"].first().cross_source_count == 1


def test_two_languages_make_one_event(spark):
    out = ingest(items(spark, [
        ("Wire", "Acme Build wins Chile rail award", "https://w.example/1", 9, "rail"), ("Ministry", "雅建集团股份中标智利铁路项目", "https://m.example/2", 6, "铁路"),
    ]), sources(spark), CONFIG, AS_OF)
    assert {r.arrival_seq: r.outcome for r in out["outcomes"].collect()} == {0: "new", 1: "duplicate"}
    assert out["events"].collect()[0].verification_status == "cross_verified"


def test_derived_tables(spark):
    gov = GovernanceRules(
        roles=("director",), appointments=(("appointment", ("appoints",)),), activities=(), person_patterns=(r"appoints ([A-Z][a-z]+) as",), surnames=("O", "K"),
        name_shape="^[A-Z][a-z]+$", org_changes=(("renamed", ("renamed",)),),
    )
    rel = RelevanceRules(
        entities=(("Acme", "acme"),), project_terms=("rail",), leader_split=r"[.;\n]", leader_pattern=r"(Acme [a-z ]*?director) ([A-Z][a-z]+) met", contract_terms=("signed",),
        event_rules=(EventRule("signing", (("signed",),)),), topics=(("account", ("Acme",), False),),
    )
    conf = replace(
        CONFIG, governance=gov, relevance=rel, policy_labels=("tax",), policy_routes={"tax_rate": "tax"}, leader_patterns=(r"director ([A-Z][a-z]+)", r"([A-Z][a-z]+) director", r"([a-z]+ director)"),
        leader_label="rail", leader_actions=("award",), activities=(("signing", "signing"),),
    )
    out = ingest(items(spark, [
        ("Ministry", "Kenya tax rate moves", "https://m.example/1", 5, "The tax falls to 5%."),
        ("Wire", "Acme Build wins Kenya rail award", "https://w.example/2", 5, "Acme deputy director Otieno met guests. They signed terms"),
        ("Wire", "Chile: Acme appoints Kariuki as director", "https://w.example/3", 5, "Unit renamed"),
    ]), sources(spark), conf, AS_OF)
    assert [(r.article_id, r.tax_rate) for r in out["policies"].collect()] == [(0, "5%")]
    assert [(r.person_name, r.organization) for r in out["leader_events"].collect()] == [("Otieno", "Acme")]
    assert [(r.person_name, r.activity_type) for r in out["activities"].collect()] == [("Otieno", "signing")]
    assert [(r.person_name, r.appointment_type, r.title_after) for r in out["personnel_events"].collect()] == [("Kariuki", "appointment", "director")]
    assert [(r.article_id, r.change_type) for r in out["org_events"].collect()] == [(2, "renamed")]


CASCADE = "arrival_seq bigint, url_key string, hash_key string, event_key string, title string, published_at timestamp, eligible boolean, confidence double"


def test_streamed_cascade_equals_batch(spark, tmp_path):
    titles = ["Harbour expansion tender opens today", "Harbour expansion tender opens today!", "Grid loan signed in the capital", "Something else entirely here"]
    rows = [(i, f"u{i % 9}", f"h{i % 7}", f"e{i % 11}", titles[i % 4], AS_OF - timedelta(days=i), i % 5 != 0, 0.5) for i in range(24)]
    df = spark.createDataFrame(rows, CASCADE)
    want = {(r.arrival_seq, r.outcome, r.leader_seq) for r in ingest_cascade(df, AS_OF).collect()}
    src = str(tmp_path / "in")
    for k in range(3):
        df.filter(F.floor(F.col("arrival_seq") / 8) == k).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.file_stream(spark, src, df.schema, files_per_trigger=1)
    jobs.ingest_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck"), AS_OF, lambda b: b).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "state"))
    assert got.select("epoch").distinct().count() == 3
    assert {(r.arrival_seq, r.outcome, r.leader_seq) for r in got.collect()} == want


def test_streamed_page_changes_equal_batch(spark, tmp_path):
    day = lambda d: AS_OF + timedelta(days=d)
    rows = [("a", day(0), "x\ny"), ("b", day(0), "1"), ("a", day(1), "x\ny"), ("a", day(2), "x\nz"), ("b", day(2), "2"), ("a", day(3), "x\nz\nw")]
    df = spark.createDataFrame(rows, "url string, captured_at timestamp, text string")
    batch = changes.change_records(changes.page_versions(df, "url", "captured_at", "text", F.to_date("captured_at")), "text")
    want = {(r.url, r.captured_at, tuple(r.added_lines), tuple(r.removed_lines)) for r in batch.collect()}
    src = str(tmp_path / "in")
    for d in range(4):
        df.filter(F.to_date("captured_at") == F.lit(day(d).date())).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.file_stream(spark, src, df.schema, files_per_trigger=1)
    jobs.page_change_stream(stream, str(tmp_path / "s"), str(tmp_path / "ck")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "s/changes"))
    assert {(r.url, r.captured_at, tuple(r.added_lines), tuple(r.removed_lines)) for r in got.collect()} == want and len(want) == 3


def test_a_new_checkpoint_goes_on_from_the_stored_versions(spark, tmp_path):
    day = lambda d: AS_OF + timedelta(days=d)
    schema = "url string, captured_at timestamp, text string"
    for k, rows in enumerate(([("a", day(0), "x\ny"), ("b", day(0), "1")], [("a", day(1), "x\nz"), ("b", day(1), "1"), ("c", day(1), "new")])):
        src = str(tmp_path / f"in{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
        stream = jobs.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        jobs.page_change_stream(stream, str(tmp_path / "s"), str(tmp_path / f"ck{k}")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "s/changes")).collect()
    assert [(r.url, r.added_lines, r.removed_lines) for r in got] == [("a", ["z"], ["y"])]
    assert spark.read.parquet(str(tmp_path / "s/versions")).count() == 4


def test_streamed_streaks_equal_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i, i % 4 != 0 and i > 2) for i in range(40)]
    df = spark.createDataFrame(rows, "source_name string, mark bigint, failed boolean")
    src = str(tmp_path / "in")
    for k in range(4):
        df.filter(F.floor(F.col("mark") / 10) == k).coalesce(1).write.mode("append").parquet(src)
    out = jobs.failure_streaks(jobs.file_stream(spark, src, df.schema, files_per_trigger=1))
    write = lambda b, e: b.write.mode("overwrite").parquet(str(tmp_path / f"o/epoch={e}"))
    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(str(tmp_path / "o")).groupBy("source_name").agg(F.max_by("consecutive_failures", "epoch").alias("n"))
    batch = health.failure_streak(df.withColumn("t", F.timestamp_seconds("mark")), "source_name", "t", "mark", F.col("failed"))
    assert {(r.source_name, r.n) for r in last.collect()} == {(r.source_name, r.consecutive_failures) for r in batch.collect()}


def test_backfill_resumes_and_keeps_undated(spark):
    day = lambda d: AS_OF - timedelta(days=d)
    rows = [(1, 1, day(1)), (1, 1, None), (1, 2, day(50)), (1, 2, day(400)), (1, 3, day(60))]
    df = spark.createDataFrame(rows, "run_id int, page_number int, published_at timestamp")
    start, end = day(365), AS_OF
    assert sorted((r.page_number, r.published_at is None) for r in jobs.backfill_window(df, start, end).collect()) == [(1, False), (1, True), (2, False)]
    done = jobs.checkpoint_rows(df.filter("page_number = 1"), start, end)
    assert [r.page_number for r in jobs.backfill_window(df, start, end, done).collect()] == [2]


def test_catalogue_streams_run_in_three_batches(spark, sf_dir):
    """State is read by the later batches: each stream of the catalogue leaves three epochs."""
    from newsloom.plans.showcase import stream_queries

    assert {r.epoch for r in stream_queries.health_state(spark, sf_dir).select("epoch").distinct().collect()} == {0, 1, 2}
    assert len({r.epoch for r in stream_queries.page_states(spark, sf_dir).select("epoch").distinct().collect()}) >= 2


def test_streak_merge_and_ledger(spark, tmp_path):
    """Successes and failures over batches, and digests that come again."""
    import random

    rng = random.Random(6)
    rows = [(f"s{rng.randrange(5)}", i, rng.random() < 0.7) for i in range(120)]
    src = str(tmp_path / "in")
    for k in range(4):
        part = spark.createDataFrame(rows[30 * k : 30 * k + 30], "source_name string, mark bigint, failed boolean")
        part.coalesce(1).write.mode("append").parquet(src)
    stream = jobs.file_stream(spark, src, part.schema, 1)
    jobs.failure_streak_stream(stream, str(tmp_path / "t"), str(tmp_path / "c")).start().awaitTermination()
    got = {r.source_name: r.consecutive_failures for r in spark.read.parquet(str(tmp_path / "t")).filter("epoch = 3").collect()}
    want: dict = {}
    for name, _, failed in rows:
        want[name] = want.get(name, 0) + 1 if failed else 0
    assert got == want
    keys = spark.createDataFrame([(f"{i % 40:04x}",) for i in range(100)], "digest string")
    for part in keys.randomSplit([1.0, 1.0, 1.0], 3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "k"))
    jobs.ledger_dedup_stream(jobs.file_stream(spark, str(tmp_path / "k"), keys.schema, 1), "digest", str(tmp_path / "l"), str(tmp_path / "d")).start().awaitTermination()
    seen = [r.digest for r in spark.read.parquet(str(tmp_path / "l")).collect()]
    assert sorted(seen) == sorted({f"{i % 40:04x}" for i in range(100)})
