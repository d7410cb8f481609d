from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, html, text, urls

AS_OF = datetime(2025, 2, 4, tzinfo=timezone.utc)


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_canonical_url(spark):
    got = values(spark, [
        "HTTP://Example.ORG//a//b/?utm_source=x&b=2&a=&GCLID=1#top", " https://example.org ", "https://example.org/p;v=1?q=a+b%2Fc&t=~*", "https://example.org/?x=%zz&&y",
    ], urls.canonical_url)
    assert got == ["http://example.org/a/b?b=2&a=", "https://example.org/", "https://example.org/p?q=a+b%2Fc&t=~%2A", "https://example.org/?x=%25zz&y="]


def test_absolute_url_and_hosts(spark):
    base = F.lit("https://site.example.org/news/list.html?p=1#x")
    got = values(spark, ["/a", "b.html", "./c", "//cdn.example.net/d", "http://x.example/e", "?p=2", "#s", ""], lambda c: urls.absolute_url(base, c))
    assert got == [
        "https://site.example.org/a", "https://site.example.org/news/b.html", "https://site.example.org/news/c", "https://cdn.example.net/d", "http://x.example/e",
        "https://site.example.org/news/list.html?p=2", "https://site.example.org/news/list.html?p=1#s", "https://site.example.org/news/list.html?p=1",
    ]
    assert values(spark, ["https://u:p@Host.example:8080/x", "ftp://a.b/c", "https:///x"], urls.is_public_url) == [False, False, False]
    assert values(spark, ["https://u:p@Host.example:8080/x"], urls.host) == ["host.example"]


def test_dates(spark):
    iso = lambda fn: lambda c: F.date_format(fn(c), "yyyy-MM-dd HH:mm:ss")
    assert values(spark, ["2024-05-01T10:00:00+08:00", "2024-05-01 garbage", "2024", "", None], iso(dates.parse_iso)) == ["2024-05-01 02:00:00", "2024-05-01 00:00:00", None, None, None]
    assert values(spark, ["1704067200", "1704067200000", "2024/1/2 3:04:05", "2024/01/02", "soon"], iso(dates.parse_export_date)) == [
        "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-02 03:04:05", "2024-01-02 00:00:00", None]
    assert values(spark, ["发布 2024年3月5日 08:30", "2024.13.01", "at 2024-02-29T07:08:09"], iso(dates.parse_page_date)) == ["2024-03-05 08:30:00", None, "2024-02-29 07:08:09"]
    assert values(spark, ["[12-20]", "03月01日", "3月8日", "2023 年 1 月 2 日", "02-30", "none"], iso(lambda c: dates.parse_list_date(c, AS_OF))) == [
        "2024-12-20 00:00:00", "2025-03-01 00:00:00", "2024-03-08 00:00:00", "2023-01-02 00:00:00", None, None]
    assert dates.date_bound("2024-01-31", True) == datetime(2024, 1, 31, 23, 59, 59, 999999, tzinfo=timezone.utc)


def test_text(spark):
    assert values(spark, ["One. Two! Three? Four."], text.rule_summary) == ["One.Two!Three?"]
    long = values(spark, ["word " * 100 + "."], text.rule_summary)[0]
    assert long.endswith("…") and len(long) <= 181
    assert values(spark, ["USD 3.5 billion and 20万 plus 7"], text.money_tokens) == [["usd 3.5 billion", " 20万"]]
    assert values(spark, ["rates 15% then 7.5%"], text.percent_tokens) == [["15%", "7.5%"]]
    assert values(spark, ["&nbsp;Acme Works、 "], text.clean_entity_name) == ["Acme Works"]
    same = values(spark, ["港口 Port—A(1)", "港口port a1"], text.name_key)
    assert same[0] == same[1]


def test_person_names(spark):
    ok = lambda c: text.plausible_person_name(c, ("王", "李"), ("欧阳",), ("公司", "任何"))
    assert values(spark, ["王小明", "欧阳修", "李任何", "张三", "王", "王小明·李四", None], ok) == [True, True, False, False, False, True, False]


def test_html(spark):
    page = (
        '<html><head><meta property="og:title" content="Rail &amp; road"><script>var t="</p>";</script></head><body><nav>menu</nav>'
        '<article><h1>Other</h1><p>Body <b>text</b></p><time datetime="2024-05-06T07:00:00Z">x</time></article><div class="box share">share me</div>'
        "<p>浏览量：15</p><p>2024-05-06</p><!-- hidden --></body></html>"
    )
    assert values(spark, [page], html.article_title) == ["Rail & road"]
    assert values(spark, [page], html.article_body) == ["Other Body text x"]
    assert values(spark, [page], html.article_date_text) == ["2024-05-06T07:00:00Z"]
    assert values(spark, [page], html.snapshot_text) == ["menu\nOther\nBody\ntext\nx"]


def test_numbers_beyond_the_calendar_are_no_date(spark):
    df = spark.createDataFrame([("999999999999999999",), ("99999999999999999999",), ("1700000000",), ("1700000000000",), ("0",)], "v string")
    got = [r[0] for r in df.select(F.date_format(dates.parse_export_date(F.col("v")), "yyyy-MM-dd")).collect()]
    assert got == [None, None, "2023-11-14", "2023-11-14", "1970-01-01"]


def test_list_dates_in_all_separators(spark):
    rows = ["2023年5月7日", "2023 / 5 / 7", "on 2023.05.07!", "5月7日", "12-30", "2-30", "none", "2023-13-01", None]
    at = datetime(2024, 6, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = [r[0] for r in df.select(F.date_format(dates.parse_list_date(F.col("v"), at), "yyyy-MM-dd")).collect()]
    assert got == ["2023-05-07"] * 3 + ["2024-05-07", "2023-12-30", None, None, None, None]


def test_query_bounds():
    day = datetime(2024, 2, 3, tzinfo=timezone.utc)
    assert dates.date_bound("2024-02-03") == day and dates.date_bound(None) is None
    assert dates.date_bound("2024-02-03", True) == day + timedelta(days=1) - timedelta(microseconds=1)
    assert dates.date_bound("2024-02-03T10:00:00+02:00", True) == day + timedelta(hours=8)
    assert dates.date_bound("2024-02-03 10:00Z") == day + timedelta(hours=10)
    with pytest.raises(ValueError, match="not an ISO date"):
        dates.date_bound("yesterday")
