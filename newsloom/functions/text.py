"""Text normalisation and token columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns decide keys and evidence and must not change.
SPACE = r"(?U)[\s\x1c-\x1f]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
MONEY = (
    r"(?U)(?:usd|eur|rmb|cny|sar|aed|美元|欧元|人民币)?\s*\d+(?:[.,]\d+)?"
    r"\s*(?:亿|万|million|billion)?"
)
PERCENT = r"(?U)\d+(?:\.\d+)?%"
UNSTABLE = r"[^a-z0-9一-鿿]+"
LABEL_SEP = "\x1f"
ENTITY_EDGE = " \t\r\n。、，；"
NAME_NOISE = r"(?U)[\s，（）()·•—/_-]+"
PERSON_SHAPE = r"^[一-鿿]{2,4}(?:·[一-鿿]{1,4})?$"


def squeeze(c: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """True when any of the literal terms occurs (stays inside generated code)."""
    if not terms:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def labels_where(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Labels whose condition holds, in order.

    Built from concat_ws and split instead of a lambda over an array, so the conditions stay in
    generated code and share their common parts.
    """
    if not pairs:
        return F.array().cast("array<string>")
    joined = F.concat_ws(LABEL_SEP, *[F.when(cond, F.lit(label)) for label, cond in pairs])
    return F.array_remove(F.split(joined, LABEL_SEP), "")


def terms_found(c: Column, terms: Sequence[str]) -> Column:
    """The literal terms that occur, in list order."""
    return labels_where([(t, c.contains(t)) for t in terms])


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``fn``."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def word_key(c: Column) -> Column:
    """Letters, digits and underscore only, lower case."""
    return F.lower(F.regexp_replace(c, NON_WORD, ""))


def content_digest(title: Column, excerpt: Column) -> Column:
    """B2: sha256 of the punctuation-free lower text."""
    return F.sha2(word_key(F.concat(title, excerpt)), 256)


def dedupe_hash(title: Column, published: Column, source: Column) -> Column:
    """Normalised title, calendar day (or ``unknown``) and source."""
    day = F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit("unknown"))
    return F.sha2(F.concat_ws("|", word_key(title), day, source), 256)


def rule_summary(c: Column, limit: int = 180) -> Column:
    """The first three sentences, cut with an ellipsis beyond ``limit``."""
    parts = F.split(squeeze(c), r"(?<=[。！？.!?])\s*", -1)
    chosen = F.trim(F.array_join(F.slice(parts, 1, 3), ""))
    cut = F.regexp_replace(F.substring(chosen, 1, limit), r"[，,；; ]+$", "")
    return F.when(F.char_length(chosen) > limit, F.concat(cut, F.lit("…"))).otherwise(chosen)


def stable_text(c: Column) -> Column:
    """A-z, 0-9 and CJK only."""
    return F.regexp_replace(F.lower(c), UNSTABLE, "")


def money_tokens(c: Column, n: int = 2) -> Column:
    """The first ``n`` amount tokens of the lower text."""
    return F.slice(F.regexp_extract_all(F.lower(c), F.lit(MONEY), F.lit(0)), 1, n)


def percent_tokens(c: Column) -> Column:
    """Every percentage token."""
    return F.regexp_extract_all(c, F.lit(PERCENT), F.lit(0))


def clean_entity_name(c: Column) -> Column:
    """Drop broken blanks, squeeze and trim list punctuation."""
    plain = F.regexp_replace(c, "&nsp;|&nbsp;", " ")
    return F.btrim(F.trim(F.regexp_replace(plain, SPACE, " ")), F.lit(ENTITY_EDGE))


def name_key(c: Column) -> Column:
    """Punctuation-free lower key of an entity name."""
    return F.regexp_replace(F.lower(clean_entity_name(c)), NAME_NOISE, "")


def display_title(c: Column) -> Column:
    """Squeeze and strip separators."""
    return F.btrim(F.regexp_replace(c, SPACE, " "), F.lit(" -—|"))


def evidence_excerpt(c: Column, n: int = 500) -> Column:
    """Squeezed text, first ``n`` characters (500, 600 or 1200 by caller).

    The whole text is squeezed only if its beginning gives fewer characters.
    """
    head = squeeze(F.substring(c, 1, 4 * n))
    return F.substring(F.when(F.char_length(head) >= n, head).otherwise(squeeze(c)), 1, n)


def plausible_person_name(
    c: Column, surnames: Sequence[str], compound_surnames: Sequence[str], stopwords: Sequence[str], shape: str = PERSON_SHAPE
) -> Column:
    """Two to four CJK characters (or another ``shape``), no stopword, known surname first."""
    name = F.btrim(F.regexp_replace(c, SPACE, ""), F.lit("·"))
    first = F.substring_index(name, "·", 1)
    head = F.substring(first, 1, 1).isin(*surnames)
    for s in compound_surnames:
        head = head | first.startswith(s)
    return F.coalesce(name.rlike(shape) & ~contains_any(name, stopwords) & head, F.lit(False))


def event_key(*parts: Column) -> Column:
    """Null-safe pipe-joined sha256."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
