"""What reading each stored page gave, and the roll-up per portal and place."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost import rules
from roost.functions.text import WB, first_match, let, normalize_text, not_blank, quickly, trim_ws, unique_strings

CHALLENGE = {
    "idealista": (
        r"(?iu)captcha-delivery\.com|please enable js and disable any ad blocker|sentimos la interrupci[oó]n"
        r"|pardon our interruption|var\s+dd\s*=\s*\{"
    ),
    "yaencontre": r"(?i)captcha-delivery\.com|please enable js and disable any ad blocker|datadome|access denied",
}
BOT_BLOCK = quickly(rules.BOT_BLOCK)
#: In lower case, texts of which every page that a pattern above matches holds one; of several in a tuple it holds all.
CHALLENGE_WORDS = {
    "idealista": [
        "captcha-delivery.com", "please enable js and disable any ad blocker", "sentimos la interrupci", "pardon our interruption",
        ("{", "var"),
    ],
}
BOT_WORDS = [
    "pardon our interruption", "as you were browsing something about your browser", "enable javascript", "access denied", "forbidden",
    "datadome", "sentimos la interrupci", "complete the captcha below", "interruption-message",
]
TITLE_ERROR = r"(?i)<title>\s*Error\s*(?:404|500)(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class PortalPolicy:
    """How one portal's adapter reads its pages. Fixed values."""

    max_requests: int
    max_listings: int | None = 20
    early_stop: bool = True
    city_filter: str = "none"  # none | filter_then_cap | cap_then_filter
    blocked: tuple[int, ...] = (403,)
    server_error: str = "http_error"  # class of HTTP 5xx
    not_found: bool = True
    error_page: str | None = None
    error_page_class: str = "template"
    empty_is_error: str | None = "UPSTREAM_UNAVAILABLE"
    counts_unavailable: bool = False
    fail_fast: tuple[str, ...] = ()
    texts: dict[str, str] = field(default_factory=dict)


TEXTS = {
    "blocked": "{portal} blocked path: {path}",
    "rate_limited": "{portal} rate-limited path: {path}",
    "not_found": "{portal} path not found: {path}",
    "http_error": "{portal} request {path} returned HTTP {status}",
    "unavailable": "{portal} request failed on {path}: timeout",
    "template": "{portal} error template on path: {path}",
    "challenge": "{portal} anti-bot challenge on path: {path}",
    "no_cards": "{portal} returned no listing cards on path: {path}",
}
POLICIES = {
    "pisos": PortalPolicy(
        6, None, False, blocked=(), not_found=False, empty_is_error="UPSTREAM_SCHEMA_CHANGED",
        fail_fast=("rate_limited",),
        texts={"http_error": "Scrape request {path} returned HTTP {status}", "no_cards": "No listings parsed from {path}",
               "unavailable": "Scrape request failed for {path}: timeout"},
    ),
    "habitaclia": PortalPolicy(
        6, 20, True, blocked=(401, 403), server_error="unavailable", not_found=False, empty_is_error=None,
        fail_fast=("rate_limited", "blocked", "unavailable", "challenge"),
        texts={"http_error": "{portal} request {path} returned HTTP {status}.",
               "no_cards": "{portal} returned no list items for {path}."},
    ),
    "tucasa": PortalPolicy(
        6, None, False, blocked=(401, 403), server_error="unavailable", empty_is_error=None, counts_unavailable=True,
        fail_fast=("challenge",),
        texts={"blocked": "{portal} blocked request: {path}", "rate_limited": "{portal} rate-limited request: {path}",
               "unavailable": "{portal} unavailable request: {path}", "not_found": "{portal} route returned 404: {path}",
               "http_error": "{portal} route returned HTTP {status}: {path}",
               "no_cards": "No structured listings parsed from {path}"},
    ),
    "fotocasa": PortalPolicy(
        9, None, False, blocked=(401, 403), not_found=False, empty_is_error=None,
        fail_fast=("rate_limited", "blocked", "challenge"),
        texts={"no_cards": "{portal} search page returned no listing links (possible anti-bot or markup change).",
               "rate_limited": "{portal} detail rate-limited: {path}", "blocked": "{portal} detail blocked: {path}",
               "challenge": "{portal} anti-bot page detected in detail: {path}"},
    ),
    "yaencontre": PortalPolicy(
        4, 20, True, "cap_then_filter", blocked=(401, 403), server_error="unavailable", not_found=False,
        empty_is_error=None, counts_unavailable=True,
        texts={"blocked": "{portal} blocked request: {path}", "rate_limited": "{portal} rate-limited request: {path}",
               "unavailable": "{portal} upstream unavailable (HTTP {status}) for {path}.",
               "http_error": "{portal} request {path} returned HTTP {status}.", "no_cards": ""},
    ),
    "milanuncios": PortalPolicy(
        6, 20, True, "cap_then_filter", blocked=(401, 403), counts_unavailable=True,
        texts={"blocked": "{portal} path blocked: {path}", "rate_limited": "{portal} rate-limited: {path}"},
    ),
    "idealista": PortalPolicy(4, 20, True, "cap_then_filter"),
    "globaliza": PortalPolicy(6, 20, True, "cap_then_filter"),
    "hogaria": PortalPolicy(
        8, 20, True, "filter_then_cap", error_page=r"(?iu)error\s*-\s*p[aá]gina no encontrada|p[aá]gina no encontrada",
        error_page_class="not_found",
    ),
    "spainhouses": PortalPolicy(
        8, 20, True, "filter_then_cap", blocked=(401, 403), counts_unavailable=True,
        error_page=r"(?i)<title>\s*(?:Error|Not Found)(?![A-Za-z0-9_])",
    ),
    "pisocompartido": PortalPolicy(
        6, 20, True, "filter_then_cap", error_page=r"(?i)error\s*404|/no_encontrado/|virtualPageName':\s*'/error404",
        error_page_class="not_found",
    ),
    "enalquiler": PortalPolicy(8, 20, True, "filter_then_cap", error_page=TITLE_ERROR),
    "nuroa": PortalPolicy(6, 20, True, "filter_then_cap", error_page=TITLE_ERROR),
}
FALLBACK_POLICY = PortalPolicy(8)


def _per_portal(value, default) -> Column:
    """A column that picks ``value(policy)`` by portal."""
    out = None
    for name, policy in POLICIES.items():
        item = value(name, policy)
        out = F.when(F.col("portal") == name, item) if out is None else out.when(F.col("portal") == name, item)
    return out.otherwise(default)


def _matches(html: Column, pattern: str, words: list[str | tuple[str, ...]] | None) -> Column:
    """``html.rlike(pattern)``, tried only on pages that hold words of the pattern.

    ``(?iu)`` takes three letters for an s or an i that lower-casing leaves or spells otherwise; a page with one is tried too.
    """
    if words is None:
        return F.coalesce(html.rlike(pattern), F.lit(False))

    def tried(low: Column) -> Column:
        held = F.lit(False)
        for word in words:
            parts = [F.contains(low, F.lit(w)) for w in ((word,) if isinstance(word, str) else word)]
            held = held | reduce(Column.__and__, parts)
        for letter in "\u017f\u0130\u0131":
            held = held | F.contains(html, F.lit(letter))
        return held & html.rlike(pattern)

    return F.coalesce(let(F.lower(html), tried), F.lit(False))


def looks_bot_blocked(html: Column) -> Column:
    return _matches(html, BOT_BLOCK, BOT_WORDS)


def challenge_id(html: Column, headers: Column) -> Column:
    """Identifier of an anti-bot challenge: a stored response header, else the page body."""
    from_header = F.coalesce(
        not_blank(trim_ws(F.element_at(headers, "x-datadome-cid"))), not_blank(trim_ws(F.element_at(headers, "x-dd-cid")))
    )
    in_body = F.coalesce(
        first_match(html, r"""(?i)["']cid["']\s*[:=]\s*["']([^"']+)["']"""),
        first_match(html, rf"""(?i){WB}cid\s*[:=]\s*["']([^"']+)["']"""),
    )
    return F.coalesce(from_header, trim_ws(in_body))


def portal_page_class(name: str, status: Column, html: Column) -> Column:
    """Class of one fetched page of a known portal, before its listings are counted."""
    p = POLICIES[name]
    challenge = _matches(html, CHALLENGE[name], CHALLENGE_WORDS.get(name)) if name in CHALLENGE else looks_bot_blocked(html)
    out = F.when(status.isNull() | (status == 0), "unavailable").when(status == 429, "rate_limited")
    if p.blocked:
        out = out.when(status.isin(list(p.blocked)), "blocked")
    if p.not_found:
        out = out.when(status == 404, "not_found")
    out = out.when(status >= 500, p.server_error)
    if name in ("yaencontre", "habitaclia"):
        # these look for a challenge before they look at other client errors
        return out.when(challenge, "challenge").when(status >= 400, "http_error").otherwise("ok")
    out = out.when((status < 200) | (status >= 300), "http_error")
    if p.error_page:
        out = out.when(F.coalesce(html.rlike(p.error_page), F.lit(False)), p.error_page_class)
    if name != "pisos":
        out = out.when(challenge, "challenge")
    return out.otherwise("ok")


def page_class(status: Column, html: Column) -> Column:
    return _per_portal(
        lambda name, _: portal_page_class(name, status, html), F.when(status == 200, "ok").otherwise("http_error")
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """Add ``page_class`` and ``challenge_id``; a column step, no shuffle."""
    return pages.withColumns(
        {
            "page_class": page_class(F.col("http_status"), F.col("html")),
            "challenge_id": challenge_id(F.col("html"), F.col("headers")),
        }
    )


def max_requests() -> Column:
    return _per_portal(lambda _, p: F.lit(p.max_requests), F.lit(FALLBACK_POLICY.max_requests))


def page_outcomes(pages: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """One row per page within the adapter's request cap: class, listing count, warning text.

    ``listings`` are the extracted rows of the same pages; without them no page counts as
    empty.
    """
    seen = classify_pages(pages.filter(F.col("page_no") <= max_requests())).drop("html", "headers")
    keys = ["portal", "crawl_location", "page_no"]
    if listings is not None:
        counts = listings.groupBy(*keys).agg(F.countDistinct("portal_listing_id").alias("n_listings"))
        joined = seen.join(
            counts.withColumnsRenamed({k: f"_{k}" for k in keys}),
            (F.col("portal") == F.col("_portal"))
            & F.col("crawl_location").eqNullSafe(F.col("_crawl_location"))
            & (F.col("page_no") == F.col("_page_no")),
            "left",
        ).drop(*[f"_{k}" for k in keys])
        seen = joined.withColumn("n_listings", F.coalesce("n_listings", F.lit(0).cast("bigint")))
        seen = seen.withColumn(
            "page_class",
            F.when((F.col("page_class") == "ok") & (F.col("n_listings") == 0), "no_cards").otherwise(F.col("page_class")),
        )
    else:
        seen = seen.withColumn("n_listings", F.lit(None).cast("bigint"))
    return seen.withColumn("warning", _warning())


def _warning() -> Column:
    def text(name: str, p: PortalPolicy) -> Column:
        out = None
        for cls, default in TEXTS.items():
            template = p.texts.get(cls, default)
            value = not_blank(F.lit(template.replace("{portal}", name)))
            out = F.when(F.col("page_class") == cls, value) if out is None else out.when(F.col("page_class") == cls, value)
        return out

    filled = F.replace(
        F.replace(_per_portal(text, F.lit(None).cast("string")), F.lit("{path}"), F.coalesce("path", F.lit(""))),
        F.lit("{status}"),
        F.coalesce(F.col("http_status").cast("string"), F.lit("")),
    )
    with_id = (
        (F.col("portal") == "idealista") & F.col("page_class").isin("blocked", "challenge") & F.col("challenge_id").isNotNull()
    )
    return F.when(with_id, F.concat(filled, F.lit(" (cid="), F.col("challenge_id"), F.lit(")"))).otherwise(filled)


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """One row per (portal, place) in ``schema.OUTCOME``; spellings of a place with one normalised text are one place.

    Only pages within the request cap are gathered, so a group holds at most nine rows.
    """
    blocked = F.col("page_class").isin("blocked", "challenge")
    fast = _per_portal(
        lambda _, p: F.col("page_class").isin(list(p.fail_fast)) if p.fail_fast else F.lit(False), F.lit(False)
    )
    first_page_only = (F.col("portal") != "fotocasa") | (F.col("page_no") == 1)
    agg = outcomes.groupBy("portal", normalize_text(F.col("crawl_location")).alias("location_key")).agg(
        F.min("crawl_location").alias("crawl_location"),
        F.count("*").alias("n"),
        F.count_if(blocked).alias("n_blocked"),
        F.count_if(F.col("page_class") == "rate_limited").alias("n_rate"),
        F.count_if(F.col("page_class") == "unavailable").alias("n_down"),
        F.coalesce(F.sum("n_listings"), F.lit(0)).alias("n_listings"),
        F.min_by(
            F.when(fast & first_page_only, F.col("page_class")),
            F.when(fast & first_page_only, F.col("page_no")),
        ).alias("fatal"),
        F.sort_array(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("page_no", "warning")))).alias("notes"),
        F.max_by("challenge_id", F.when(blocked & F.col("challenge_id").isNotNull(), -F.col("page_no"))).alias("cid"),
    )
    counts_down = _per_portal(lambda _, p: F.lit(p.counts_unavailable), F.lit(False))
    empty_code = _per_portal(
        lambda _, p: F.lit(p.empty_is_error).cast("string"), F.lit("UPSTREAM_UNAVAILABLE")
    )
    fatal_code = (
        F.when(F.col("fatal") == "rate_limited", "UPSTREAM_RATE_LIMIT")
        .when(F.col("fatal").isin("blocked", "challenge"), "UPSTREAM_BLOCKED")
        .when(F.col("fatal") == "unavailable", "UPSTREAM_UNAVAILABLE")
    )
    none_found = F.col("n_listings") == 0
    counted = ~F.col("portal").isin("habitaclia", "fotocasa", "pisos")
    code = F.coalesce(
        fatal_code,
        F.when(none_found & counted & (F.col("n_rate") == F.col("n")), "UPSTREAM_RATE_LIMIT"),
        F.when(none_found & counted & (F.col("n_blocked") == F.col("n")), "UPSTREAM_BLOCKED"),
        F.when(none_found & counts_down & (F.col("n_down") == F.col("n")), "UPSTREAM_UNAVAILABLE"),
        F.when(none_found, empty_code),
    )
    portal = F.col("portal")
    cid_note = F.when(
        (portal == "idealista") & F.col("cid").isNotNull(), F.concat(F.lit(" ("), F.col("cid"), F.lit(")"))
    ).otherwise(F.lit(""))
    message = (
        F.when(code == "UPSTREAM_RATE_LIMIT", F.concat(portal, F.lit(" rate-limited all candidate requests.")))
        .when(
            code == "UPSTREAM_BLOCKED",
            F.concat(portal, F.lit(" blocked automated access for all candidate paths"), cid_note, F.lit(".")),
        )
        .when(code == "UPSTREAM_SCHEMA_CHANGED", "Scraper extracted no listings from selected pages.")
        .when(
            code.isNotNull() & (F.col("n_down") == F.col("n")),
            F.concat(portal, F.lit(" unavailable for all candidate requests.")),
        )
        .when(code.isNotNull(), F.concat(portal, F.lit(" returned no usable listings for the provided criteria.")))
    )
    texts = unique_strings(F.transform("notes", lambda x: x["warning"]))
    empty_note = F.when(
        (portal == "yaencontre") & none_found & code.isNull(), F.array(F.lit("yaencontre returned no parseable listings."))
    ).otherwise(F.array().cast("array<string>"))
    return agg.select(
        "portal",
        "crawl_location",
        "location_key",
        F.lit("scrape").alias("source_kind"),
        F.concat(texts, empty_note).alias("warnings"),
        code.alias("error_code"),
        message.alias("error_message"),
        "n_listings",
    )
