"""Portal pages rendered from the property view, one layout per portal.

The pages are what an outside collector would store; the extraction jobs read them back.
Blocks of one page are the portal's orders of one nation in one range of 6500 order keys,
some twenty, so building a page gathers a bounded number of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roost import rules
from roost.sources.views import listing_view, spread

ORDERS_PER_PAGE_RANGE = 6500
LD = '<script type="application/ld+json">'

# Page markup per portal: (head, block, tail). Names in braces are filled per listing.
LAYOUTS = {
    "pisos": ("<main>", '<div id="{id}" class="ad-preview big"><a href="/comprar/inmueble-{id}/" class="ad-preview__title">{title}</a>'
              '<p class="p-sm ad-preview__subtitle">{city}</p><span class="ad-preview__price">{price} &euro;</span>'
              '<p class="ad-preview__char p-sm">{rooms}</p><p class="ad-preview__description">{text}</p><script></script></div>', "</main>"),
    "habitaclia": ("<main>", '<article class="row js-list-item" data-id="{id}" data-href="/x-i{id}.htm"><a itemprop="name">{title}</a>'
                   '<i data-pvp="{digits}"></i></article>', "</main>"),
    "tucasa": (LD + '{"@graph":[{"@type":"ItemList","itemListElement":[', "{json}", "]}]}</script>"),
    "fotocasa": ("<main>", '<article><a href="/es/comprar/vivienda/{place}/zona/{id}/d?from=list">x</a><h3>{title}</h3><b>{price} €</b></article>', "</main>"),
    "yaencontre": ('<script>window.__INITIAL_STATE__ = JSON.parse(atob("', "{state}", '"))</script>'),
    "milanuncios": ("<main>", '<article class="ma-AdCardV2"><a class="ma-AdCardListingV2-TitleLink" href="/venta-de-inmuebles/x-{id}.htm">x</a>'
                    '<h2 class="ma-AdCardV2-title">{title}</h2><span class="ma-AdLocation-text">{city}</span>'
                    '<span class="ma-AdPrice-value">{price} €</span><p class="ma-AdCardV2-description">{text}</p></article>', "</main>"),
    "idealista": ("<main>", '<article><a href="/inmueble/{id}/">x</a><h2>{title}</h2><address>{city}</address>'
                  '<span class="item-price">{price} eur</span><p>{text}</p></article>', "</main>"),
    "globaliza": ("<ul>", '<li class="serp-snippet ad"><a class="detail-redirection" href="/inmueble/{id}">x</a><h2 class="title">{title}</h2>'
                  '<meta itemprop="addressLocality" content="{city}"><div class="price">{price} €</div><p class="description">{text}</p></li>', "</ul>"),
    "hogaria": ("<main>", '<div class="item col-xs-4 col-lg-4 grid-group-item" itemprop="offers"><a itemprop="url" href="/venta/x_{id}.aspx">{title}</a>'
                '<p itemprop="price">{price}</p><h3 class="h2ubicacion">{city}</h3><div itemprop="description">{text}</div>'
                '<input type="hidden" name="listado$ctl1$codigo"></div>', "</main>"),
    "spainhouses": ("<main>", '<article class="property_block" data-position="{id}" data-href="/es/x-{id}.html"><div class="title_1"><a>{title}</a></div>'
                    '<div class="title_2">{city}</div><div class="descTxt">{text}</div><span class="price">{price}</span></article>', "</main>"),
    "pisocompartido": ("<main>", '<div id="h{id}" class=" card"><a class="linkCard" href="/anuncio/{id}/">x</a><h6 class="textoTipo">{title}</h6>'
                       '<div class="contLocalizacion"><h5>{city}</h5></div><span class="contPrecio">{price} €</span>' + LD + "{product}</script></div>",
                       '<div class="cCardsFooter"></div></main>'),
    "enalquiler": ("<ul>", '<li id="property-{id}" class="propertyCard"><a class="propertyCard__description--title" href="/x_{id}.html"><p>{title}</p></a>'
                   '<div class="propertyCard__location"><p>{city}</p></div><span class="propertyCard__price--value">{price} €</span>'
                   '<p class="propertyCard__description--txt">{text}</p></li>', "</ul>"),
    "nuroa": ("<main>", '<div class="group nu_row" id="nu_flat_{id}"><a class="nu_adlink" href="/go/{id}">x</a><h3 class="nu_list_title"><a>{title}</a></h3>'
              '<div class="nu_address_text">{city}</div><span class="nu_price">{price} €</span>'
              '<div itemprop="description"><p>{text}</p></div></div>', "</main>"),
}


def _escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def portal_pages(spark: SparkSession, sf_dir: str, portal: str) -> DataFrame:
    """Stored pages of one portal, in the page schema."""
    rows = listing_view(spark, sf_dir).filter(F.col("portal") == portal)
    rooms = F.concat(F.col("rooms").cast("int").cast("string"), F.lit(" habs."))
    rows = rows.select(
        "portal_listing_id", "seq", "crawl_location", F.coalesce(rooms, F.lit("")).alias("rooms"),
        F.concat(F.col("title"), F.coalesce(F.concat(F.lit(", "), rooms), F.lit(""))).alias("title"),
        F.when(F.col("city") == "", F.col("crawl_location")).otherwise(F.col("city")).alias("city"),
        F.coalesce(F.floor("price_eur").cast("string"), F.lit("")).alias("digits"),
        _escape(F.col("description")).alias("text"),
    )
    offers = F.struct(F.col("digits").alias("price"))
    item = F.struct(
        F.concat(F.lit("/x?id="), F.col("portal_listing_id")).alias("url"), F.col("title").alias("name"), F.col("text").alias("description"),
        offers.alias("offers"), F.struct(F.struct(F.col("city").alias("addressLocality")).alias("address")).alias("mainEntity"),
    )
    entry = F.struct(
        F.struct(
            F.concat(F.lit("/venta/x/"), F.col("portal_listing_id")).alias("url"), F.col("portal_listing_id").alias("reference"),
            F.col("title"), F.col("text").alias("description"), F.when(F.col("digits") != "", F.col("digits").cast("bigint")).alias("price"),
            F.struct(F.concat(F.col("city"), F.lit(", Spain")).alias("qualifiedName")).alias("address"),
        ).alias("item")
    )
    product = F.struct(F.lit("Product").alias("@type"), F.col("text").alias("description"))
    values = {
        "id": F.col("portal_listing_id"),
        "title": _escape(F.col("title")),
        "city": _escape(F.col("city")),
        "price": F.when(F.col("digits") != "", F.col("digits")).otherwise("Consultar"),
        "digits": F.col("digits"),
        "rooms": F.col("rooms"),
        "text": F.col("text"),
        "place": F.replace(F.lower("crawl_location"), F.lit("_"), F.lit("-")),
        "json": F.to_json(F.struct(item.alias("item"))),
        "state": F.concat(F.lit('"'), F.col("portal_listing_id"), F.lit('":'), F.to_json(entry)),
        "product": F.to_json(product),
    }
    head, block, tail = LAYOUTS[portal]
    glue = "," if portal in ("tucasa", "yaencontre") else ""
    blocks = rows.select(
        "crawl_location", "seq", (F.floor(F.col("seq") / ORDERS_PER_PAGE_RANGE) + 1).cast("int").alias("page_no"),
        _fill(block, values).alias("block"),
    )
    # pages are read where they are built: a task for few of them, so that no core waits for the last ones
    pages = (
        spread(blocks, "crawl_location", "page_no")
        .groupBy("crawl_location", "page_no")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "block"))).alias("blocks"))
    )
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), glue)
    if portal == "yaencontre":
        state = F.concat(F.lit('{"results":{"currentPageItems":{"byId":{'), body, F.lit("}}}}"))
        # standard base64 text without the line breaks of the MIME form
        body = F.translate(F.base64(F.encode(state, "UTF-8")), "\r\n", "")
    return pages.select(
        F.lit(portal).alias("portal"),
        "crawl_location",
        F.concat(F.lit("/venta/"), F.col("page_no").cast("string")).alias("path"),
        "page_no",
        F.lit(200).alias("http_status"),
        F.concat(F.lit(head), body, F.lit(tail)).alias("html"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        F.lit(None).cast("map<string,string>").alias("headers"),
    )


def nested_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tucasa pages whose list lies 2 to 25 objects and arrays deep, by page and place."""
    pages = portal_pages(spark, sf_dir, "tucasa")
    wraps = F.pmod(F.col("page_no") + F.length("crawl_location"), F.lit(12))
    head, _, tail = LAYOUTS["tucasa"]
    opened = F.concat(F.lit(LD), F.repeat(F.lit('{"part":['), wraps), F.lit(head.removeprefix(LD)))
    closed = F.concat(F.lit(tail.removesuffix("</script>")), F.repeat(F.lit("]}"), wraps), F.lit("</script>"))
    inner = F.substr("html", F.lit(len(head) + 1), F.length("html") - len(head) - len(tail))
    return pages.withColumn("html", F.concat(opened, inner, closed))


PORTAL_LAYOUTS = [p for p in rules.PORTALS if p in LAYOUTS]
