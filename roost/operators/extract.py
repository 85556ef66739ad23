"""Stored portal pages -> canonical listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost import schema
from roost.functions.text import normalize_text
from roost.operators.dedupe import first_by_key
from roost.operators.outcomes import POLICIES, max_requests, portal_page_class
from roost.operators.portals import cards, structured

PORTAL_JOBS = {
    "pisos": structured.pisos,
    "habitaclia": cards.habitaclia,
    "tucasa": structured.tucasa,
    "fotocasa": structured.fotocasa,
    "yaencontre": structured.yaencontre,
    "milanuncios": cards.milanuncios,
    "idealista": structured.idealista,
    "globaliza": cards.globaliza,
    "hogaria": cards.hogaria,
    "spainhouses": cards.spainhouses,
    "pisocompartido": cards.pisocompartido,
    "enalquiler": cards.enalquiler,
    "nuroa": cards.nuroa,
}
PLACE = ["portal", "crawl_location"]
_COLUMNS = [f.name for f in schema.LISTING.fields]


def with_page_columns(pages: DataFrame) -> DataFrame:
    """Optional page columns filled in: ``requested_type`` is the one type a page was fetched for."""
    have = set(pages.columns)
    for name, kind in (("requested_type", "string"), ("headers", "map<string,string>"), ("fetched_at", "timestamp")):
        if name not in have:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages


def page_listings(pages: DataFrame, portals: list[str] | None = None) -> DataFrame:
    """Every listing of every usable page, with its page and arrival order; nothing dropped yet.

    One branch per portal. Store pages partitioned by ``portal``: each branch then reads
    only its own partition and the job is one pass over the pages in all.
    """
    pages = with_page_columns(pages)
    frames = []
    for name in portals or list(PORTAL_JOBS):
        readable = portal_page_class(name, F.col("http_status"), F.col("html")) == "ok"
        frames.append(PORTAL_JOBS[name](pages.filter((F.col("portal") == name) & readable)))
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def _arrival() -> list[Column]:
    """Detail rows before cards and the latest detail first; else first come, first kept."""
    replaces = (F.col("portal") == "fotocasa") & (F.col("tier") == 0)
    return [F.col("tier").asc(), F.when(replaces, -F.col("seq")).otherwise(F.col("seq")).asc()]


def extract_listings(pages: DataFrame, portals: list[str] | None = None) -> DataFrame:
    """Canonical listings, one row per portal, place and portal id."""
    rows = page_listings(pages, portals)
    return first_by_key(rows, [*PLACE, "portal_listing_id"], _arrival()).select(*_COLUMNS)


def _flag(value) -> Column:
    out = None
    for name, policy in POLICIES.items():
        item = F.lit(value(policy))
        out = F.when(F.col("portal") == name, item) if out is None else out.when(F.col("portal") == name, item)
    return out


def adapter_results(rows: DataFrame) -> DataFrame:
    """What one adapter call per (portal, place) returns from ``page_listings`` rows.

    Request cap, early stop once enough raw rows came in, first-wins per id, then the
    portal's own order of listing cap and city filter. The city filter keeps all rows when
    none matches; ``broadened`` tells so. Only per-page counts and capped rows are ever
    gathered per place.
    """
    keep_all = 1_000_000_000
    limit = F.coalesce(_flag(lambda p: p.max_listings), F.lit(keep_all))
    rows = rows.filter(F.col("page_no") <= max_requests())
    page = [*PLACE, "page_no"]
    counts = rows.groupBy(*page).agg(F.countDistinct("portal_listing_id").alias("n"))
    before = F.sum("n").over(
        Window.partitionBy(*PLACE).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    read = counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(
        ~_flag(lambda p: p.early_stop) | (F.col("before") < limit)
    )
    kept = rows.join(read.select(*[F.col(k).alias(f"_{k}") for k in page]),
        (F.col("portal") == F.col("_portal"))
        & F.col("crawl_location").eqNullSafe(F.col("_crawl_location"))
        & (F.col("page_no") == F.col("_page_no")),
        "left_semi",
    )
    unique = first_by_key(kept, [*PLACE, "portal_listing_id"], _arrival())
    target = normalize_text(F.coalesce("crawl_location", F.lit("")))
    mode = _flag(lambda p: p.city_filter)
    match = F.contains(normalize_text(F.coalesce("city", F.lit(""))), target)
    unique = unique.withColumn("_match", match).withColumn(
        "_first", F.when((mode == "filter_then_cap") & ~F.col("_match"), 1).otherwise(0)
    )
    uncapped = [n for n, p in POLICIES.items() if p.max_listings is None]
    capped = unique.filter(~F.col("portal").isin(uncapped))
    top = Window.partitionBy(*PLACE).orderBy("_first", "seq")
    bound = max(p.max_listings for p in POLICIES.values() if p.max_listings)
    capped = capped.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= bound).filter(F.col("_rank") <= limit)
    any_match = F.max("_match").over(Window.partitionBy(*PLACE))
    filtered = (
        capped.withColumn("_any", any_match)
        .filter((mode == "none") | F.col("_match") | ~F.col("_any"))
        .withColumn("broadened", (mode != "none") & (target != "") & ~F.col("_any"))
    )
    whole = unique.filter(F.col("portal").isin(uncapped)).withColumn("broadened", F.lit(False))
    columns = [*_COLUMNS, "page_no", "broadened"]
    return filtered.select(*columns).unionByName(whole.select(*columns))
