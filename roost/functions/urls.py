"""URL columns. Plain regular expressions: stored links are often not valid URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roost.functions.text import let, not_blank, trim_ws

# scheme, optional user info, host, optional port, path, query, fragment
_PARTS = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/:?#@\s]+)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def url_host(url: Column) -> Column:
    """Lower-case host, '' when the text is no web URL."""
    return F.lower(_part(trim_ws(url), 2))


def url_path(url: Column) -> Column:
    return _part(trim_ws(url), 4)


def listing_url_key(url: Column) -> Column:
    """Host and path without trailing slashes, else the trimmed text; lower-case."""

    def key(clean: Column) -> Column:
        located = F.regexp_replace(F.concat(_part(clean, 2), _part(clean, 4)), r"/+\z", "")
        return F.lower(F.when(clean.rlike(_PARTS), located).otherwise(clean))

    return let(trim_ws(url), key)


def safe_https_url(url: Column) -> Column:
    """https URL without user info and default port; null for anything else."""

    def rebuild(clean: Column) -> Column:
        path = _part(clean, 4)
        rebuilt = F.concat(
            F.lit("https://"),
            F.lower(_part(clean, 2)),
            F.regexp_replace(_part(clean, 3), r"^:0*443\z", ""),
            F.when(path == "", "/").otherwise(path),
            _part(clean, 5),
            _part(clean, 6),
        )
        return F.when(F.lower(_part(clean, 1)) == "https", rebuilt)

    return let(trim_ws(url), rebuild)


def domain_of(url: Column) -> Column:
    """Host without a leading ``www.``; '' when the text is no web URL."""
    return F.regexp_replace(url_host(url), r"^www\.", "")


def absolute_url(link: Column, base: str) -> Column:
    """Resolve a link found in a page of ``base`` (a site root)."""

    def resolve(href: Column) -> Column:
        return (
            F.when(href.rlike("(?i)^https?://"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href))
            .otherwise(F.concat(F.lit(base + "/"), href))
        )

    return let(link, resolve)


def form_decode(value: Column) -> Column:
    """Decode a raw query value as a form does (`+` is a blank); bad escapes keep the text."""
    return let(value, lambda v: F.coalesce(F.try_url_decode(v), v))


def percent_decode(value: Column, rounds: int) -> Column:
    """Percent-decode up to ``rounds`` times, keeping `+`; a bad escape keeps the last good text."""
    out = value
    for _ in range(rounds):
        out = let(out, lambda v: F.coalesce(F.try_url_decode(F.regexp_replace(v, r"\+", "%2B")), v))
    return out


def query_value(url: Column, name: str) -> Column:
    """Form-decoded value of the first query parameter ``name``; null when absent or empty."""
    raw = not_blank(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))
    return form_decode(raw)
