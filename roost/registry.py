"""Named queries over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roost import rules
from roost.functions.numbers import format_price
from roost.functions.text import normalize_text, slugify, strip_tags
from roost.functions.urls import domain_of, listing_url_key, safe_https_url
from roost.operators import present, status
from roost.operators.clean import clean_listings
from roost.operators.collapse import collapse_table
from roost.operators.extract import adapter_results, extract_listings, page_listings
from roost.operators.outcomes import looks_bot_blocked, outcome_rollup, page_outcomes
from roost.operators.rank import rank_listings
from roost.operators.search import run_search
from roost.operators.versions import PageVersions, latest_pages as newest_pages
from roost.plans.crawl_plan import best_suggestions, crawl_plan
from roost.plans.search_plan import plan_requests, plan_tasks
from roost.sources import views
from roost.sources.page_views import PORTAL_LAYOUTS, nested_list_pages, portal_pages
from roost.sources.staging import checkpoint_dir
from roost.streaming.rate_limit import client_key, rate_limit_audit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _line(name: str, sep: str = " | ") -> Column:
    return F.array_join(name, sep).alias(name)


_STAGED: dict[tuple, object] = {}


def _search(spark, sf_dir, **options):
    """The search batch; queries of one application share its staged tables."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(options.items()))
    if key not in _STAGED:
        _STAGED[key] = run_search(views.search_view(spark, sf_dir), views.listing_view(spark, sf_dir), **options)
    return _STAGED[key]


# -- search -----------------------------------------------------------------------------

@query
def search_results(spark, sf_dir):
    """Every saved search: ranked, collapsed, spread over places."""
    return _search(spark, sf_dir).results.select(
        "search_id", _big("result_rank"), "canonical_id", _big("score"), _line("why_matched").alias("why"), "location"
    )


@query
def search_coverage(spark, sf_dir):
    """Listings seen and returned per search, place and portal, with relax notes."""
    return _search(spark, sf_dir).coverage.select(
        "search_id", _big("loc_pos"), _big("src_pos"), "location", "portal", "candidates", "returned", "relax_note"
    )


@query
def search_diagnostics(spark, sf_dir):
    """Counts and ordered warnings per search."""
    return _search(spark, sf_dir).diagnostics.select(
        "search_id", "status", "total_candidates", "returned_count", _line("connector_warnings"),
        _line("request_warnings"), _line("locations_searched"), _big("max_results_total"),
    )


@query
def search_action_required(spark, sf_dir):
    """Strict searches that name no place."""
    return _search(spark, sf_dir).action_required


@query
def search_city_scope(spark, sf_dir):
    """Coverage when listings belong to every place their city text names."""
    return _search(spark, sf_dir, scope="city").coverage.select("search_id", _big("loc_pos"), _big("src_pos"), "candidates")


@query
def search_by_customer(spark, sf_dir):
    """One search per customer; equal questions are run once."""
    out = run_search(views.customer_search_view(spark, sf_dir), views.listing_view(spark, sf_dir))
    return out.results.select("search_id", _big("result_rank"), "canonical_id", _big("score"))


@query
def search_plan(spark, sf_dir):
    """Planned tasks with their caps and merged hints."""
    tasks = plan_tasks(plan_requests(views.search_view(spark, sf_dir)))
    return tasks.select(
        "search_id", _big("loc_pos"), "location", _big("src_pos"), "portal", _big("cap"),
        F.array_join("q.location_hints", " | ").alias("hints"),
    )


RANK_CRITERIA = {
    "city": "NATION_3", "min_rooms": 2, "max_price_eur": 300000, "strict_constraints": False, "min_floor": 1,
    "tags": ["natural_light", "views"], "location_hints": ["Centro", "Alto"], "prefer_exterior": True, "renovation_ok": True,
}


@query
def rank_one_search(spark, sf_dir):
    """All listings that meet one search, scored and explained."""
    ranked = rank_listings(views.listing_view(spark, sf_dir), RANK_CRITERIA)
    return ranked.select("canonical_id", _big("score"), _line("why_matched").alias("why"))


# -- cleaning ---------------------------------------------------------------------------

@query
def page_text(spark, sf_dir):
    """Visible text of every raw page."""
    text = strip_tags(F.col("html"))
    return views.table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("n_chars"))


@query
def page_links(spark, sf_dir):
    """URL columns and the bot-block test of every raw page."""
    url = F.col("url")
    return views.table(spark, sf_dir, "pages").select(
        "page_id", listing_url_key(url).alias("url_key"), safe_https_url(url).alias("safe_url"), domain_of(url).alias("domain"),
        looks_bot_blocked(F.col("html")).alias("bot_blocked"),
    )


@query
def document_text(spark, sf_dir):
    """Normalised words and slugs of whole documents."""
    norm, slug = normalize_text(F.col("text")), slugify(F.col("text"))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(norm).alias("norm_md5"), F.md5(slug).alias("slug_md5"), F.length(norm).cast("bigint").alias("n_chars")
    )


@query
def cleaned_listings(spark, sf_dir):
    """Cleaned columns of the raw listing view."""
    price = F.concat(F.translate(F.format_number(F.floor("price_eur"), 0), ",", "."), F.lit(" €"))
    rows = clean_listings(views.listing_view(spark, sf_dir).withColumn("price_raw", price))
    return rows.select(
        "canonical_id", "title_norm", "price_eur", "rooms", "floor_no", "property_type", _line("tags"), "url_key", "safe_url",
        "domain", format_price(F.col("price_eur"), F.lit("es")).alias("price_es"), format_price(F.col("price_eur"), F.lit("en")).alias("price_en"),
    )


@query
def collapse_listings(spark, sf_dir):
    """All listings without those that an earlier one has the URL of or nearly equals: cheapest, roomiest, newest first."""
    return collapse_table(views.listing_view(spark, sf_dir)).select("canonical_id", "price_eur", "rooms")


# -- extraction: one query per portal layout -----------------------------------------------

def _extracted(rows: DataFrame) -> DataFrame:
    return rows.select(
        "canonical_id", "crawl_location", "url", "title", "city", "price_eur", "rooms", "property_type",
        F.md5("description").alias("description_md5"), _line("tags"),
    )


def _extract(portal: str) -> Query:
    def run(spark, sf_dir):
        return _extracted(extract_listings(portal_pages(spark, sf_dir, portal), [portal]))

    run.__doc__ = f"Listings read back from stored {portal} pages."
    return run


for _portal in PORTAL_LAYOUTS:
    QUERIES[f"extract_{_portal}"] = _extract(_portal)


@query
def extract_nested_lists(spark, sf_dir):
    """Listings read back from tucasa pages whose lists lie up to 25 levels deep, beside flat ones."""
    return _extracted(extract_listings(nested_list_pages(spark, sf_dir), ["tucasa"]))


@query
def adapter_caps(spark, sf_dir):
    """What adapter calls keep of the stored pages: request cap, early stop, city filter, listing cap."""
    frames = [adapter_results(page_listings(portal_pages(spark, sf_dir, p), [p])) for p in ("milanuncios", "spainhouses")]
    return frames[0].unionByName(frames[1]).select("canonical_id", "crawl_location", "broadened")


def _raw_page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as a fetch log: portal, place and status by page id."""
    pid = F.col("page_id")
    return views.table(spark, sf_dir, "pages").select(
        F.element_at(F.array(*[F.lit(p) for p in rules.PORTALS]), (pid % 13 + 1).cast("int")).alias("portal"),
        F.concat(F.lit("Place "), F.floor(pid / 39).cast("string")).alias("crawl_location"),
        F.concat(F.lit("/p/"), pid.cast("string")).alias("path"),
        (F.floor(pid / 13) % 3 + 1).cast("int").alias("page_no"),
        F.element_at(F.array(*[F.lit(s) for s in (200, 403, 429, 404, 503, 200, 401)]), (F.floor(pid / 39) % 7 + 1).cast("int")).alias("http_status"),
        "html",
        F.lit(None).cast("map<string,string>").alias("headers"),
    )


@query
def page_classes(spark, sf_dir):
    """Outcome class and warning of every page of the fetch log."""
    return page_outcomes(_raw_page_log(spark, sf_dir)).select("portal", "crawl_location", _big("page_no"), "page_class")


@query
def outcome_rollups(spark, sf_dir):
    """Outcome per portal and place of the fetch log."""
    log = page_outcomes(_raw_page_log(spark, sf_dir)).withColumn("n_listings", F.lit(0).cast("bigint"))
    return outcome_rollup(log).select("portal", "crawl_location", "error_code")


# Status of the pages of the fetch history: of the place that no portal lets in, and of the others.
_SHUT, _MIXED = (403, 429, 503), (200, 403, 429, 404, 503, 200, 401)


def _fetch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as fetches over time: 130 pages (13 portals, 5 places in two spellings, 2 numbers), out of order and at equal times."""
    pid = F.col("page_id")
    place = F.floor(pid / 13) % 5
    mixed = ((F.floor(pid / 13) + pid % 13 * 3) % 7 + 1).cast("int")
    spelled = F.when(F.floor(pid / 130) % 2 == 0, F.concat(F.lit("NATION_"), place.cast("string"))).otherwise(
        F.concat(F.lit(" nation-"), place.cast("string"), F.lit(" "))
    )
    number = (F.floor(pid / 65) % 2 + 1).cast("int")
    return views.table(spark, sf_dir, "pages").select(
        F.element_at(F.array(*[F.lit(p) for p in rules.PORTALS]), (pid % 13 + 1).cast("int")).alias("portal"),
        spelled.alias("crawl_location"),
        F.concat(F.lit("/p/"), number.cast("string")).alias("path"),
        number.alias("page_no"),
        F.when(place == 0, F.element_at(F.array(*[F.lit(c) for c in _SHUT]), (pid % 3 + 1).cast("int")))
        .otherwise(F.element_at(F.array(*[F.lit(c) for c in _MIXED]), mixed))
        .alias("http_status"),
        F.timestamp_seconds(F.lit(1_704_067_200) + pid * 37 % 101 * 3600).alias("fetched_at"),
        pid.cast("bigint").alias("fetch_id"),
        "html",
        F.lit(None).cast("map<string,string>").alias("headers"),
    )


def _read_outcomes(pages: DataFrame) -> DataFrame:
    """Page outcomes; a page that could be read gave five listings."""
    return page_outcomes(pages).withColumn("n_listings", F.when(F.col("page_class") == "ok", 5).otherwise(0).cast("bigint"))


@query
def latest_pages(spark, sf_dir):
    """The newest fetch of every page of the fetch history and what it gave."""
    rows = page_outcomes(newest_pages(_fetch_history(spark, sf_dir)))
    return rows.select("portal", "location_key", _big("page_no"), "fetch_id", "page_class")


def _versions(spark, sf_dir) -> PageVersions:
    """The fetch history applied in three batches that mix old and new fetches."""
    store = PageVersions(spark, f"{checkpoint_dir(spark).rstrip('/')}/roost/pages-{uuid.uuid4().hex}")
    outcomes = _read_outcomes(_fetch_history(spark, sf_dir))
    for batch in range(3):
        store.apply(batch, outcomes.filter(F.floor(F.col("fetch_id") * 7 / 5) % 3 == batch))
    return store


@query
def outcomes_incremental(spark, sf_dir):
    """Outcome per portal and place, kept over three batches with late fetches."""
    return _versions(spark, sf_dir).rollup().select("portal", "location_key", "error_code", "n_listings")


@query
def page_totals_incremental(spark, sf_dir):
    """Kept pages per portal, place and class as sums of signed changes over the same batches."""
    return _versions(spark, sf_dir).totals().select("portal", "location_key", "page_class", _big("n_pages"), _big("n_listings"))


def _search_read(spark, sf_dir):
    """The search batch over listings whose portals were read with the newest outcomes of the fetch history."""
    key = (spark.sparkContext.applicationId, sf_dir, "outcomes")
    if key not in _STAGED:
        outcomes = outcome_rollup(_read_outcomes(newest_pages(_fetch_history(spark, sf_dir))))
        _STAGED[key] = run_search(views.search_view(spark, sf_dir), views.listing_view(spark, sf_dir), outcomes)
    return _STAGED[key]


@query
def search_with_outcomes(spark, sf_dir):
    """Every saved search without the listings of portals that could not be read for its place."""
    return _search_read(spark, sf_dir).results.select("search_id", _big("result_rank"), "canonical_id", _big("score"))


@query
def public_coverage(spark, sf_dir):
    """Published coverage per search, place and portal: source kind, counts, error code and its public sentence."""
    return status.public_diagnostics(_search_read(spark, sf_dir).coverage).select(
        "search_id", _big("loc_pos"), _big("src_pos"), "location", "portal", "source", "candidates", "returned", "error_code",
        "public_message",
    )


@query
def search_failures(spark, sf_dir):
    """Searches for which every portal failed, with the first error."""
    return _search_read(spark, sf_dir).failures.select("search_id", "error_code")


# -- presentation -------------------------------------------------------------------------

def _public(spark, sf_dir) -> DataFrame:
    return present.public_listings(_search(spark, sf_dir).results)


def _cards(spark, sf_dir) -> DataFrame:
    return present.present_cards(_public(spark, sf_dir))


@query
def public_rows(spark, sf_dir):
    """Published rows: safe links only, texts cut to their published lengths."""
    return _public(spark, sf_dir).select(
        "search_id", _big("result_rank"), "url", "title", F.size("image_urls").cast("bigint").alias("n_images"),
        F.md5("description").alias("description_md5"), _line("tags"), "floor_label", "lat",
    )


@query
def result_cards(spark, sf_dir):
    """First 20 published rows of every search as cards."""
    return _cards(spark, sf_dir).select(
        "search_id", _big("card_pos"), "canonical_id", "source_domain", "price", _line("facts"), "image_url", "latitude", "longitude",
    )


@query
def result_markdown(spark, sf_dir):
    """One card text per search in its language."""
    searches = views.search_view(spark, sf_dir).select("search_id", "locale")
    return present.cards_markdown(_cards(spark, sf_dir), searches)


def _points(spark, sf_dir) -> DataFrame:
    return present.map_points(_cards(spark, sf_dir))


@query
def card_points(spark, sf_dir):
    """Map point of every card."""
    return _points(spark, sf_dir).select(
        "search_id", "canonical_id", "exact", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


@query
def card_bounds(spark, sf_dir):
    """Map box of every search."""
    box = present.map_bounds(_points(spark, sf_dir))
    return box.select("search_id", "n_points", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query
def portal_counts(spark, sf_dir):
    """Portals with data per search."""
    out = _search(spark, sf_dir)
    return status.portals_with_data(out.coverage, present.present_cards(present.public_listings(out.results)))


# -- status, planning, request log ---------------------------------------------------------

def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe attempts: events grouped by portal and attempt."""
    uid = F.col("user_id")
    portal = F.element_at(F.array(*[F.lit(p) for p in rules.PORTALS]), (uid % 13 + 1).cast("int"))
    errors = F.count_if(F.col("event_type") == "error")
    hits = F.count_if(F.col("value") > 40)
    return (
        views.table(spark, sf_dir, "events")
        .groupBy(portal.alias("portal"), ((uid % 3) + 1).cast("int").alias("attempt"))
        .agg(errors.alias("n_errors"), hits.alias("hits"))
        .select(
            "portal", "attempt", (F.col("hits") % 5).alias("returned_count"),
            F.when(F.col("n_errors") % 3 == 0, "UPSTREAM_BLOCKED").when(F.col("n_errors") % 7 == 1, "UPSTREAM_RATE_LIMIT").alias("error_code"),
        )
    )


@query
def probe_status(spark, sf_dir):
    """Portal status from up to two probe attempts."""
    return status.portal_status(_attempts(spark, sf_dir)).select(_big("position"), "portal", "portal_url", "state", "returned_count")


@query
def probe_summary(spark, sf_dir):
    """Probe counts by kind of outcome."""
    return status.smoke_summary(_attempts(spark, sf_dir))


@query
def crawl_paths(spark, sf_dir):
    """Pages to fetch for every saved search."""
    tasks = plan_tasks(plan_requests(views.search_view(spark, sf_dir)))
    return crawl_plan(tasks).select("search_id", _big("loc_pos"), _big("src_pos"), "portal", _big("page_no"), "path")


@query
def place_suggestions(spark, sf_dir):
    """Best suggestion per nation: customers' segments play the candidates."""
    nation = views.table(spark, sf_dir, "nation")
    rows = (
        views.table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("city"),
            F.col("c_custkey").alias("pos"),
            F.when(F.col("c_custkey") % 3 == 0, "city").when(F.col("c_custkey") % 3 == 1, "District").alias("type"),
            F.when(F.col("c_custkey") % 5 == 0, F.col("n_name")).otherwise(F.concat(F.col("n_name"), F.lit(" "), F.col("c_mktsegment"))).alias("name"),
            F.col("c_nationkey").cast("double").alias("province"),
            (F.col("c_custkey") % 50).cast("double").alias("location"),
            (F.col("c_custkey") % 900).cast("double").alias("quantity"),
        )
    )
    return best_suggestions(rows).select("city", "name", "province", "location", _big("score"))


@query
def request_audit(spark, sf_dir):
    """Rate-limit verdict of every event, five per hour and user kind."""
    events = views.table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts")
    )
    return rate_limit_audit(events, limit=1, window_seconds=3600).select(
        "event_id", "key", _big("n_in_window"), "allowed", _big("remaining"), _big("retry_after_seconds")
    )


@query
def request_audit_default(spark, sf_dir):
    """Verdicts of the published limit, twelve a minute; the log runs a hundred times as fast, a third of it by one client."""
    user = F.col("user_id")
    events = views.table(spark, sf_dir, "events").select(
        "event_id",
        client_key(F.when(user % 3 == 0, "10.0.0.1, 10.9.9.9").otherwise(F.concat(F.lit("10.1.0."), user % 200))).alias("key"),
        F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100)).alias("ts"),
    )
    return rate_limit_audit(events).select(
        "event_id", "key", _big("n_in_window"), "allowed", _big("remaining"), _big("retry_after_seconds")
    )
