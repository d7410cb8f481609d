"""URL columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that never identify a document.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query (empty string when absent)."""
    return F.regexp_extract(F.trim(url), _URL, group)


def host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    authority = F.regexp_replace(F.lower(url_part(url, 2)), r"^.*@", "")
    return F.regexp_replace(authority, r":\d*$", "")


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _form_encode(c: Column) -> Column:
    # java.net.URLEncoder keeps '*' and escapes '~'; form encoding here does the opposite.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, drop_keys: Sequence[str] = TRACKING_KEYS) -> Column:
    """B1: one spelling per document address.

    Scheme and host are lower case, repeated and trailing slashes go, fragment,
    path parameters and tracking keys go, the remaining query pairs keep their order.
    """
    path = F.regexp_replace(F.regexp_replace(url_part(url, 3), r";[^/]*$", ""), "/{2,}", "/")
    path = F.regexp_replace(path, "/+$", "")
    pairs = F.filter(F.split(url_part(url, 4), "&"), lambda p: p != "")
    fields = F.transform(
        pairs,
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("k"),
            _form_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(fields, lambda f: ~F.lower(f["k"]).isin(*drop_keys))
    query = F.array_join(F.transform(kept, lambda f: F.concat(_form_encode(f["k"]), F.lit("="), _form_encode(f["v"]))), "&")
    scheme, authority = F.lower(url_part(url, 1)), F.lower(url_part(url, 2))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        F.when(path == "", "/").otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against its page (absolute, protocol-relative, rooted, query, relative)."""
    h = F.trim(href)
    origin = F.concat(url_part(base, 1), F.lit("://"), url_part(base, 2))
    folder = F.regexp_replace(url_part(base, 3), "[^/]*$", "")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(url_part(base, 1), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(origin, url_part(base, 3), h))
        .otherwise(
            F.concat(
                origin,
                F.when(folder == "", "/").otherwise(folder),
                F.regexp_replace(h, r"^(?:\./)+", ""),
            )
        )
    )


def is_public_url(url: Column) -> Column:
    """http(s), with a host, without user info."""
    authority = url_part(url, 2)
    return F.lower(url_part(url, 1)).isin("http", "https") & (authority != "") & ~authority.contains("@")


def is_valid_item(title: Column, url: Column) -> Column:
    """A title of four characters or more and an http(s) address with a host."""
    ok = (F.char_length(title) >= 4) & F.lower(url_part(url, 1)).isin("http", "https") & (url_part(url, 2) != "")
    return F.coalesce(ok, F.lit(False))


def host_in(url: Column, allowed: Sequence[str]) -> Column:
    """Allow-list test on the host."""
    return host(url).isin(*allowed)
