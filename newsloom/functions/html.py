"""HTML columns built from native regular expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import squeeze

# The entities the text columns decode ('&amp;' must stay last).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
COUNTER_LINE = r"^(?:访问量|浏览量|点击量)[:：]?\s*\d+$"
DATE_LINE = r"^\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?$"
NOISE_CLASSES = ("visit-count", "view-count", "share", "tools")


def drop_blocks(html: Column, tags: Sequence[str]) -> Column:
    """Remove comments and whole elements.  Runs first: scripts may hold markup text."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return out


def drop_classes(html: Column, classes: Sequence[str] = NOISE_CLASSES) -> Column:
    """Remove elements whose class list holds one of ``classes``."""
    names = "|".join(classes)
    return F.regexp_replace(
        html, rf'(?is)<(\w+)\b[^>]*\bclass="(?:[^"]*\s)?(?:{names})(?:\s[^"]*)?"[^>]*>.*?</\1\s*>', " "
    )


def unescape(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def plain_text(html: Column) -> Column:
    """Text nodes joined by one blank."""
    return squeeze(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def element(html: Column, tag: str) -> Column:
    """Inner HTML of the first element with this tag, NULL when absent."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))


def attribute(tag_html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag_html, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def meta_content(html: Column, key: str) -> Column:
    """Content of the first meta tag whose property or name is ``key``."""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*["']{key}["'][^>]*>""", 0)
    return attribute(tag, "content")


def article_title(html: Column) -> Column:
    """Og:title, twitter:title, first h1, then the document title."""
    return F.coalesce(
        squeeze(unescape(meta_content(html, "og:title"))),
        squeeze(unescape(meta_content(html, "twitter:title"))),
        F.nullif(plain_text(element(html, "h1")), F.lit("")),
        F.nullif(plain_text(element(html, "title")), F.lit("")),
    )


def article_date_text(html: Column) -> Column:
    """Publication meta tags, then the first time element."""
    time_tag = F.regexp_extract(html, r"(?is)<time\b[^>]*>", 0)
    return F.coalesce(
        meta_content(html, "article:published_time"),
        meta_content(html, "publishdate"),
        meta_content(html, "date"),
        attribute(time_tag, "datetime"),
        F.nullif(plain_text(element(html, "time")), F.lit("")),
    )


def article_body(html: Column) -> Column:
    """Text of article, main or body after chrome elements are removed."""
    clean = drop_blocks(html, ("script", "style", "noscript", "nav", "footer", "form", "iframe"))
    return F.coalesce(*[F.nullif(plain_text(element(clean, t)), F.lit("")) for t in ("article", "main", "body")])


def snapshot_lines(html: Column) -> Column:
    """Trimmed text lines without counters and bare dates."""
    clean = drop_classes(drop_blocks(html, ("script", "style", "noscript", "iframe")))
    raw = F.split(unescape(F.regexp_replace(clean, r"(?s)<[^>]*>", "\n")), "\n")
    lines = F.transform(raw, squeeze)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COUNTER_LINE) & ~x.rlike(DATE_LINE))


def snapshot_text(html: Column) -> Column:
    return F.array_join(snapshot_lines(html), "\n")
