"""Readers, imports, catalogue and sinks on landed files of our own."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.sources import catalog, imports, readers, sinks

AS_OF = datetime(2025, 2, 4, tzinfo=timezone.utc)
HOSTS = ("posts.example.org",)


def test_rss(spark, tmp_path):
    entry = lambda i: f"<item><title>Story  number {i}</title><link>https://x.example/s/{i}?utm_source=rss&amp;a=1</link><description>&lt;p&gt;Hello &lt;b&gt;{i}&lt;/b&gt;&lt;/p&gt;</description><pubDate>Mon, 0{i} Jan 2024 10:00:00 +0200</pubDate></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(entry(i) for i in range(1, 6)) + "<item><title>No</title><link>x</link></item></channel></rss>")
    rows = readers.read_source(spark, "rss", str(tmp_path / "f.xml"), limit=3).orderBy("position").collect()
    assert [(r.title, r.url, r.excerpt, r.published_at.strftime("%m-%d %H")) for r in rows] == [
        (f"Story number {i}", f"https://x.example/s/{i}?a=1", f"Hello {i}", f"01-0{i} 08") for i in (1, 2, 3)]
    with pytest.raises(ValueError):
        readers.read_source(spark, "ftp", "x")


def test_sitemap(spark, tmp_path):
    loc = lambda p, d: f"<url><loc>https://s.example/{p}</loc>" + (f"<lastmod>{d}</lastmod>" if d else "") + "</url>"
    (tmp_path / "s.xml").write_text("<urlset>" + loc("news/big-rail_deal", "2024-01-02") + loc("news/older-story/", "2023-01-02") + loc("about/us-page", "2024-02-02") + loc("news/no-date", "") + "</urlset>")
    rows = readers.read_sitemap(spark, str(tmp_path / "s.xml"), include="/news/", limit=2).collect()
    assert [r.title for r in rows] == ["big rail deal", "older story"]
    assert [r.title for r in readers.read_sitemap(spark, str(tmp_path / "s.xml"), include="/news/", exclude="older", page=2, limit=1).collect()] == ["no date"]


def test_list_sections_and_leads(spark):
    html = (
        '<ul><li><a href="/news/20240105.html" title="Bridge opened to traffic">x</a><time datetime="2024-01-05">d</time><p>Short  text</p></li>'
        '<li><a href="http://other.example/p">Elsewhere page</a></li></ul><a href="/centre">News centre</a><a href="/media">Media news</a><a href="https://leads.example.net/a">Outside lead</a>'
    )
    pages = spark.createDataFrame([("https://h.example/index.html", html)], "url string, html string")
    item = readers.list_items(pages, AS_OF).filter("position = 0").collect()[0]
    assert (item.title, item.url, item.excerpt, str(item.published_at.date())) == ("Bridge opened to traffic", "https://h.example/news/20240105.html", "Short text", "2024-01-05")
    links = readers.anchors(pages)
    got = readers.discover_sections(links, ["News", "Media"]).orderBy("rank").collect()
    assert [(r.link_url, r.score) for r in got] == [("https://h.example/centre", 100), ("https://h.example/media", 99), ("https://h.example/index.html", 0)]
    leads = {(r.label, r.link_only) for r in readers.news_leads(links, AS_OF, ["leads.example.net"]).collect()}
    assert leads == {("Bridge opened to traffic", False), ("Outside lead", True)}


def test_catalogue_batches(spark):
    rows = [(f"u{i}", i, "notice of board" if i % 4 == 0 else "plain", AS_OF - timedelta(days=i * 30) if i != 7 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "url string, position int, title string, published_at timestamp")
    got = {r.url for r in readers.select_catalogue(df, ["board"], AS_OF, recent=2, priority=5, lookback_days=200).collect()}
    assert got == {"u0", "u1", "u4"}
    seen, cursor = [], 0
    while cursor is not None:
        batch, state = readers.offset_batch(df, cursor, 5)
        seen += [r.url for r in batch.collect()]
        cursor = int(state["next_cursor"]) if state["next_cursor"] else None
    assert seen == [f"u{i}" for i in range(12) if i != 7] + ["u7"] and state["exhausted"]


def export(tmp_path, name, payload):
    (tmp_path / name).write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")


def test_import_envelopes_and_csv(spark, tmp_path):
    row = {"msg_title": " Line one ", "link": "https://posts.example.org/s/1", "publish_time": 1704067200, "digest": "lead", "body": "full text"}
    export(tmp_path, "list.json", "﻿" + json.dumps([row]))
    export(tmp_path, "env.json", {"data": [row], "v": 1})
    export(tmp_path, "one.json", {"title": "Line one", "url": "https://posts.example.org/s/1", "publish_time": "2024-01-01", "summary": "lead", "content": "full text"})
    rows = imports.json_rows(imports.read_exports(spark, str(tmp_path), "json"))
    good, bad, counts = imports.normalize_rows(rows, HOSTS)
    got = {(r.title, r.original_url, r.summary, r.content_text, r.published_at.date().isoformat()) for r in good.collect()}
    assert got == {("Line one", "https://posts.example.org/s/1", "lead", "full text", "2024-01-01")} and good.count() == 3 and bad.count() == 0
    export(tmp_path, "t.csv", '﻿title,url,content,date\n"Quoted, title",https://posts.example.org/s/2,"a\nb",2024/01/05\n,https://posts.example.org/s/3,x,\n')
    good, bad, counts = imports.normalize_rows(imports.csv_rows(spark, str(tmp_path / "t.csv")), HOSTS)
    assert [(r.row_number, r.title, r.content_text) for r in good.collect()] == [(1, "Quoted, title", "a\nb")]
    assert [(r.row_number, r.reason) for r in bad.collect()] == [(2, imports.REASON_TITLE)]


def test_import_rejects_secrets_and_limits(spark, tmp_path):
    ok = {"title": "fine", "url": "https://posts.example.org/s/1", "content": "text"}
    export(tmp_path, "ok.json", [ok, {"title": "bad host", "url": "https://evil.example/x"}])
    export(tmp_path, "key.json", [dict(ok, pass_ticket="1")])
    export(tmp_path, "nested.json", [dict(ok, meta={"Private-Key": "x"})])
    export(tmp_path, "url.json", [dict(ok, cover="https://a.example/i?appmsg-token=5")])
    export(tmp_path, "text.json", [dict(ok, note="set cookie = abc")])
    export(tmp_path, "pem.json", [dict(ok, note="-----BEGIN PRIVATE KEY-----")])
    export(tmp_path, "many.json", [ok] * 4)
    export(tmp_path, "none.json", {"x": 1})
    export(tmp_path, "big.json", [dict(ok, content="x" * imports.MAX_BYTES)])
    files = imports.read_exports(spark, str(tmp_path), "json")
    rows, refused = imports.accepted(imports.json_rows(files), files, max_records=3)
    reason = {r.file.rsplit("/", 1)[1]: r.reason for r in refused.collect()}
    secret = "secret material"
    assert reason == {"key.json": secret, "nested.json": secret, "url.json": secret, "text.json": secret, "pem.json": secret, "many.json": "too many records", "none.json": "no article list", "big.json": "file too large"}
    good, bad, _ = imports.normalize_rows(rows, HOSTS)
    assert good.count() == 1 and [(r.row_number, r.reason) for r in bad.collect()] == [(2, imports.REASON_URL)]


def test_replay_returns_the_first_batch(spark):
    led = spark.createDataFrame([(1, "ann", "f", "s", "completed", AS_OF), (2, "ann", "g", "s", "processing", AS_OF)], "batch_id int, requested_by string, file_sha256 string, source_name string, status string, created_at timestamp")
    req = spark.createDataFrame([("ann", "f", "s"), ("ann", "g", "s"), ("bo", "f", "s")], "requested_by string, file_sha256 string, source_name string")
    assert sorted((r.requested_by, r.file_sha256, r.earlier_batch_id) for r in imports.replayed(req, led).collect()) == [("ann", "f", 1), ("ann", "g", None), ("bo", "f", None)]


def test_response_precedence(spark):
    rows = [("a", False, 429, "<rss>"), ("b", True, 429, "captcha"), ("c", True, 200, "captcha paywall"), ("d", True, 200, "<rss><item></item></rss>"), ("e", True, 200, '<script src="x"></script>')]
    df = spark.createDataFrame(rows, "source_name string, robots_allowed boolean, http_status int, body string").withColumns({"content_type": F.lit("text/html"), "feed_body": F.lit(None).cast("string"), "sitemap_body": F.lit(None).cast("string")})
    got = {r.source_name: (r.status, r.test_count, r.crawlable) for r in catalog.classify_responses(df).collect()}
    assert got == {"a": ("robots_blocked", 0, False), "b": ("rate_limited", 0, False), "c": ("javascript_required", 0, False), "d": ("rss_available", 1, True), "e": ("javascript_required", 0, False)}


def test_upsert_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "articles")
    day = lambda m: datetime(2024, m, 5, tzinfo=timezone.utc)
    base = spark.createDataFrame([(1, "a", day(1), 0), (2, "b", day(2), 0), (3, "c", None, 0)], "id int, v string, published_at timestamp, arrival_seq int")
    sinks.write_months(base, path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "articles").glob("pub_month=2024-01/*.parquet")}
    change = spark.createDataFrame([(2, "b1", day(2), 1), (2, "b2", day(2), 2), (4, "d", day(2), 1)], base.schema)
    sinks.upsert_months(spark, path, change)
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b2"), (3, "c"), (4, "d")]
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "articles").glob("pub_month=2024-01/*.parquet")}
    assert sinks.read_months(spark, path, ["undated"]).count() == 1


def test_lists_with_other_elements_keep_their_objects(spark):
    files = spark.createDataFrame([("a", '[{"title":"x","n":1}, 5, null, "{no", {"title":"y"}]'), ("b", '{"articles":[{"title":"z"},3]}'), ("c", "[1, 2]")], "file string, content string")
    got = [(r.file, r.row_number, r.row["title"]) for r in imports.json_rows(files).orderBy("file", "row_number").collect()]
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]


def test_atom_and_rss_entries_in_file_order(spark, tmp_path):
    atom = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>T</title>
    <entry><title type="html">First</title><link rel="self" href="https://a.example.org/self"/><link href="https://a.example.org/1"/>
      <updated>2024-01-02T03:04:05Z</updated><author><name>Ann</name></author><summary type="html">&lt;p&gt;One&lt;/p&gt;</summary></entry>
    <entry><title>Second</title><link rel="alternate" href="https://a.example.org/2"/><published>2024-01-03T00:00:00Z</published></entry></feed>"""
    items = "".join(f"<item><title>Notice {i}</title><link>https://r.example.org/{i}</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><author>Bo</author></item>" for i in range(60))
    (tmp_path / "a.xml").write_text(atom)
    (tmp_path / "r.xml").write_text(f"<rss><channel><title>C</title>{items}</channel></rss>")
    rows = readers.read_rss(spark, str(tmp_path)).orderBy("feed", "position").collect()
    first, second = rows[:2]
    assert (first.title, first.url, first.author, first.excerpt) == ("First", "https://a.example.org/1", "Ann", "One")
    assert (second.title, second.url, second.published_at.isoformat()[:10]) == ("Second", "https://a.example.org/2", "2024-01-03")
    assert [r.title for r in rows[2:]] == [f"Notice {i}" for i in range(50)]
    assert rows[2].author == "Bo" and rows[2].published_at == first.published_at


def test_a_feed_link_needs_an_address(spark):
    body = '<html><link rel="alternate" type="application/rss+xml"{}></html>'
    rows = [(str(i), True, 200, "text/html", b, None, None) for i, b in enumerate([body.format(""), body.format(' href="/feed"'), "<p>验证您是真人</p>"])]
    frame = spark.createDataFrame(rows, "source_name string, robots_allowed boolean, http_status int, content_type string, body string, feed_body string, sitemap_body string")
    got = {r.source_name: r.status for r in catalog.classify_responses(frame).collect()}
    assert got["1"] == "rss_available" and got["0"] != "rss_available" and got["2"] == "javascript_required"
