"""Portals whose result pages are lists of HTML cards.

Each function maps the usable pages of one portal to canonical rows: split the page into
blocks, read fields by pattern, derive the rest. Patterns name the page markup and are
fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost import rules
from roost.functions.json import is_array, member, number, raw_string
from roost.functions.numbers import parse_number, parse_price, parse_rooms
from roost.functions.text import WB, WE, WS, all_matches, decode_entities, first_match, not_blank, slugify, strip_tags, trim_ws, unique_strings
from roost.functions.urls import absolute_url, percent_decode, query_value
from roost.operators.portals import common as c



def _read(block: Column, pattern: str) -> Column:
    """Decoded visible text of a capture; null when it is missing or empty."""
    return strip_tags(decode_entities(not_blank(first_match(block, pattern))))


def _join(*parts: Column) -> Column:
    """Texts joined by blanks, as a template string would."""
    return F.concat(*[x for part in parts for x in (F.lit(" "), part)][1:])


def habitaclia(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["habitaclia"]
    start = r"""<article[^>]*class=["'][^"']*js-list-item[^"']*["'][^>]*>"""
    name_link = r"""(?i)<a[^>]*itemprop=["']name["'][^>]*"""
    rows = c.explode_blocks(pages, c.split_at(F.col("html"), start))
    tag, block = F.col("tag"), F.col("block")
    rows = rows.withColumn("tag", F.regexp_extract("block", f"(?i)^{start}", 0)).withColumns(
        {
            "href": F.coalesce(
                not_blank(decode_entities(c.attribute(tag, "data-href"))),
                not_blank(_read(block, name_link + r"""href=["']([^"']+)["'][^>]*>""")),
            ),
            "tag_id": decode_entities(c.attribute(tag, "data-id")),
            "kind": F.upper(
                _join(
                    F.coalesce(decode_entities(c.attribute(tag, "data-propertysubtype")), F.lit("")),
                    F.coalesce(decode_entities(c.attribute(tag, "data-propertytype")), F.lit("")),
                )
            ),
            "name": _read(block, name_link + r">((?s:.*?))</a>"),
            "price_raw": _read(block, r"""(?i)<span[^>]*class=["'][^"']*font-2[^"']*["'][^>]*>([^<]+)</span>"""),
            "surface": parse_number(_read(block, r"""(?i)data-sup=["']([0-9]+)["']""")),
            "image_tag": F.regexp_extract(block, r"""(?i)<img[^>]*itemprop=["']image["'][^>]*>""", 0),
            "baths": first_match(strip_tags(block), r"(?iu)([0-9]+)\s*ba(?:ñ|n)os?"),
        }
    )
    rows = rows.filter("href IS NOT NULL").withColumn("url", c.full_url(F.col("href"), base))
    path = c.page_path(F.col("url"))
    rows = rows.withColumn(
        "portal_listing_id",
        F.coalesce(
            F.when(F.col("tag_id").rlike(r"^[0-9]+\z"), F.col("tag_id")),
            not_blank(F.regexp_extract("block", r"""(?i)data-codanuncio=["']([0-9]+)["']""", 1)),
            not_blank(F.regexp_extract(path, r"(?i)-i([0-9]+)\.htm", 1)),
            c.slug_id(path, F.col("url")),
        ),
    ).withColumn("title", F.coalesce("name", F.concat(F.lit("Inmueble "), F.col("portal_listing_id"))))
    rows = rows.withColumns(
        {
            "price_eur": F.coalesce(parse_price(_read(block, r"""(?i)data-pvp=["']([0-9]+)["']""")), parse_price(F.col("price_raw"))),
            "rooms": F.coalesce(parse_number(_read(block, r"""(?i)data-hab=["']([0-9]+)["']""")), parse_rooms(F.col("title"))),
            "property_type": F.coalesce(
                F.when(F.contains("kind", F.lit("OFFICE")), "office"),
                c.type_by(
                    F.col("kind"),
                    [
                        ("LAND|PLOT|RUSTIC|SOIL|SOLAR|TERRENO", "land"),
                        ("FLAT|APARTMENT|PENTHOUSE|STUDIO|LOFT|DUPLEX", "flat"),
                        ("HOUSE|CHALET|VILLA|SINGLE_FAMILY|PAIRED|SEMI|RURAL|TOWNHOUSE", "house"),
                    ],
                ),
                c.infer_type(F.col("title")),
            ),
            "city": c.city_or_place(
                not_blank(c.title_words(first_match(F.lower(path), r"-([a-z0-9_]+)-i[0-9]+\.htm"), "_"))
            ),
            "src": not_blank(decode_entities(c.attribute(F.col("image_tag"), "src"))),
            "baths_label": F.concat(not_blank(F.col("baths")), F.lit(" baños")),
            "area_label": F.concat(F.floor(F.col("surface") + 0.5).cast("string"), F.lit(" m²")),
        }
    )
    rows = rows.withColumns(
        {
            "description": F.concat_ws(" · ", not_blank(F.col("title")), F.col("baths_label"), F.col("area_label")),
            "chars": F.array_compact(
                F.array(F.concat(c.number_text(F.col("rooms")), F.lit(" habs.")), F.col("baths_label"), F.col("area_label"))
            ),
            "image_urls": c.one_image(absolute_url(F.col("src"), base)),
            "capacity_people": c.office_capacity(F.col("property_type"), F.col("surface")),
            "price_raw": not_blank(F.col("price_raw")),
        }
    ).withColumn("tags", c.infer_tags(_join(F.col("title"), F.col("description"))))
    return c.finish(rows, "habitaclia")


def _nuroa_target(href: Column, base: str) -> Column:
    """Outbound link behind a tracking link: a direct ``url`` value, or the one nested in ``redirectUrl``."""
    link = c.full_url(decode_entities(href), base)
    web = "(?i)^https?://"
    direct = percent_decode(query_value(link, "url"), 5)
    redirect = percent_decode(query_value(link, "redirectUrl"), 5)
    nested = percent_decode(query_value(redirect, "url"), 5)
    return (
        F.when(direct.rlike(web), direct)
        .when(redirect.isNull() | ~redirect.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link)
        .when(nested.rlike(web), nested)
        .otherwise(redirect)
    )


def nuroa(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["nuroa"]
    start = r"""<div[^>]*class=["'][^"']*group\s+nu_row[^"']*["'][^>]*id=["']nu_flat_[^"']+["'][^>]*>"""
    # images of the whole page by listing id, for cards without one of their own; last entry wins
    tags = all_matches(F.col("html"), r"""(?i)<img[^>]*id=["']ad-img-[^"']+["'][^>]*>""", 0)

    def entry(tag: Column) -> Column:
        src = F.coalesce(
            first_match(tag, r"""(?i)data-original=["']([^"']+)["']"""), first_match(tag, r"""(?i)src=["']([^"']+)["']""")
        )
        return F.struct(first_match(tag, r"""(?i)id=["']ad-img-([^"']+)["']""").alias("id"), src.alias("src"))

    index = F.filter(F.transform(tags, entry), lambda e: e["src"].isNotNull() & ~e["src"].rlike("(?i)no_image"))
    rows = c.explode_blocks(pages, c.split_at(F.col("html"), start), index.alias("images"))
    block = F.col("block")
    rows = rows.withColumns(
        {
            "portal_listing_id": first_match(block, r"""(?i)id=["']nu_flat_([^"']+)["']"""),
            "href": first_match(block, c.attr_of("a", "nu_adlink", "href")),
        }
    ).filter("href IS NOT NULL AND portal_listing_id IS NOT NULL")
    photo = lambda attr: first_match(block, c.attr_of("img", "nu_list_image", attr))
    own = F.coalesce(photo("data-original"), photo("src"), photo("data-src"))
    listed = F.try_element_at(F.filter("images", lambda e: e["id"] == F.col("portal_listing_id")), F.lit(-1))["src"]
    rows = rows.withColumns(
        {
            "url": c.full_url(_nuroa_target(F.col("href"), base), base),
            "title": c.text_of(
                block,
                rf"(?i){c.open_tag('h3', 'nu_list_title')}(?s:.*?)<a[^>]*>((?s:.*?))</a>",
                default=F.concat(F.lit("Inmueble "), F.col("portal_listing_id")),
            ),
            "city": c.text_of(block, c.inner("div", "nu_address_text"), default=c.city_or_place(F.lit(None))),
            "description": c.text_of(
                block, r"""(?i)<div[^>]*itemprop=["']description["'][^>]*>(?s:.*?)<p>((?s:.*?))</p>"""
            ),
            "photo": F.coalesce(F.when(~own.rlike("(?i)no_image"), own), listed),
            "content_price": not_blank(
                F.regexp_extract(block, r"""(?i)itemprop=["']price["'][^>]*content=["']([0-9.]+)["']""", 1)
            ),
        }
    )
    text = _join(F.col("title"), F.col("description"))
    path = F.lower(c.page_path(F.col("url")))
    rows = rows.withColumns(
        {
            "rooms": parse_rooms(text),
            "bathrooms": c.bathrooms_in(F.col("description")),
            "area_m2": c.area_in(F.col("description")),
            "price_eur": F.coalesce(
                parse_number(F.replace(F.col("content_price"), F.lit("."), F.lit(""))),
                parse_price(c.text_of(block, c.inner("span", "nu_price"))),
            ),
            # a word counts when it starts after a slash or at a word start and ends a word or meets an underscore
            "property_type": F.coalesce(
                c.type_by(
                    path,
                    [
                        (rf"(?iu){WB}(?:piso|apartamento|atico|d[úu]plex|loft)(?:{WE}|_)", "flat"),
                        (rf"(?iu){WB}(?:casa|chalet|adosad[ao]|paread[ao]|villa)(?:{WE}|_)", "house"),
                        (rf"(?iu){WB}(?:oficina|despacho|local)(?:{WE}|_)", "office"),
                        (rf"(?iu){WB}(?:terreno|solar|parcela|suelo)(?:{WE}|_)", "land"),
                    ],
                ),
                c.infer_type(text),
            ),
            "image_urls": c.one_image(absolute_url(decode_entities(F.col("photo")), base)),
            "tags": c.infer_tags(text),
        }
    )
    rows = rows.withColumns(
        {
            "chars": c.measure_chars(F.col("rooms"), F.col("bathrooms"), F.col("area_m2")),
            "capacity_people": c.office_capacity(F.col("property_type"), F.col("area_m2")),
        }
    )
    return c.finish(rows, "nuroa")


def spainhouses(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["spainhouses"]
    rows = c.explode_blocks(
        pages, c.split_at(F.col("html"), r"""<article[^>]*class=["'][^"']*property_block[^"']*["'][^>]*>""")
    )
    block = F.col("block")
    rows = rows.withColumns(
        {
            "portal_listing_id": F.coalesce(
                first_match(block, r"""(?i)data-position=["']([^"']+)["']"""), first_match(block, r"""(?i)data-id=["']([^"']+)["']""")
            ),
            "href": F.coalesce(
                first_match(block, r"""(?i)data-href=["']([^"']+)["']"""),
                first_match(block, r"""(?i)<a[^>]*href=["']([^"']+)["'][^>]*data-position=["'][^"']+["']"""),
            ),
            "head": F.concat(
                c.text_of(block, rf"(?i){c.open_tag('div', 'title_1')}(?s:.*?)<a[^>]*>((?s:.*?))</a>"),
                c.text_of(block, c.inner("span", "titleTail")),
            ),
            "city": c.text_of(block, c.inner("div", "title_2"), default=c.city_or_place(F.lit(None))),
            "features": c.text_of(block, c.inner("div", "features")),
            "description": c.text_of(block, c.inner("div", "descTxt")),
            "price_text": c.text_of(block, c.inner("span", "price")),
            "photo": F.coalesce(
                first_match(
                    block, r"""(?i)<img[^>]*data-src=["']([^"']+)["'][^>]*class=["'][^"']*slide-content[^"']*["']"""
                ),
                first_match(block, c.attr_of("img", "slide-content", "data-src")),
            ),
        }
    ).filter("href IS NOT NULL AND portal_listing_id IS NOT NULL")
    rows = rows.withColumns(
        {
            "url": c.full_url(decode_entities(F.col("href")), base),
            "title": F.coalesce(
                not_blank(trim_ws(F.col("head"))), F.concat(F.lit("Inmueble "), F.col("portal_listing_id"))
            ),
        }
    )
    details = _join(F.col("features"), F.col("description"))
    path = F.lower(c.page_path(F.col("url")))
    rows = rows.withColumns(
        {
            "rooms": parse_rooms(_join(F.col("features"), F.col("title"), F.col("description"))),
            "bathrooms": c.bathrooms_in(details),
            "area_m2": c.area_in(details),
            "price_eur": parse_price(F.col("price_text")),
            "price_raw": F.when(F.col("price_text") != "", F.concat(F.col("price_text"), F.lit(" €"))),
            "property_type": F.coalesce(
                c.type_by(
                    path,
                    [
                        ("(?:venta|alquiler)-pisos|apartamento|piso|atico|duplex|loft", "flat"),
                        ("(?:venta|alquiler)-casas|casa|chalet|villa|adosad", "house"),
                        ("(?:venta|alquiler)-oficinas|oficina|local", "office"),
                        ("(?:venta|alquiler)-terrenos|terreno|solar|parcela|suelo", "land"),
                    ],
                ),
                c.infer_type(_join(F.col("title"), F.col("features"), F.col("description"))),
            ),
            "image_urls": c.one_image(
                absolute_url(decode_entities(F.when(~F.col("photo").rlike(r"(?i)pix\.gif"), F.col("photo"))), base)
            ),
            "tags": c.infer_tags(_join(F.col("title"), F.col("description"))),
        }
    )
    rows = rows.withColumns(
        {
            "chars": c.measure_chars(F.col("rooms"), F.col("bathrooms"), F.col("area_m2")),
            "capacity_people": c.office_capacity(F.col("property_type"), F.col("area_m2")),
        }
    )
    return c.finish(rows, "spainhouses")


def enalquiler(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["enalquiler"]
    start = r"""<li[^>]*id=["']property-[0-9]+["'][^>]*class=["'][^"']*propertyCard[^"']*["'][^>]*>"""
    rows = c.explode_blocks(pages, c.split_at(F.col("html"), start))
    block = F.col("block")
    link = c.open_tag("a", "propertyCard__description--title")
    rows = rows.withColumns(
        {
            "portal_listing_id": first_match(block, r"""(?i)id=["']property-([0-9]+)["']"""),
            "href": first_match(block, c.attr_of("a", "propertyCard__description--title", "href")),
            "price_text": c.text_of(block, c.inner("span", "propertyCard__price--value")),
            "details": c.text_of(block, c.inner("ul", "propertyCard__details")),
            "description": c.text_of(block, c.inner("p", "propertyCard__description--txt")),
            "city": c.text_of(
                block,
                rf"(?i){c.open_tag('div', 'propertyCard__location')}(?s:.*?)<p>((?s:.*?))</p>",
                default=c.city_or_place(F.lit(None)),
            ),
            "photo": F.coalesce(
                first_match(block, r"""(?i)<img[^>]*itemprop=["']image["'][^>]*srcset=["']([^"']+)["']"""),
                first_match(block, r"""(?i)<source[^>]*srcset=["']([^"']+)["']"""),
            ),
        }
    ).filter("href IS NOT NULL AND portal_listing_id IS NOT NULL")
    rows = rows.withColumns(
        {
            "url": c.full_url(F.col("href"), base),
            "title": c.text_of(
                block,
                rf"(?i){link}(?s:.*?)<p[^>]*>((?s:.*?))</p>",
                default=F.concat(F.lit("Inmueble "), F.col("portal_listing_id")),
            ),
        }
    )
    path = F.lower(c.page_path(F.col("url")))
    text = _join(F.col("title"), F.col("description"))
    rows = rows.withColumns(
        {
            "rooms": parse_rooms(_join(F.col("details"), text)),
            "bathrooms": c.bathrooms_in(F.col("details"), c.BATHROOMS_OPEN),
            "area_m2": c.area_in(F.col("details"), c.AREA_OPEN),
            "price_eur": parse_price(F.col("price_text")),
            "price_raw": not_blank(F.col("price_text")),
            "property_type": F.coalesce(
                c.type_by(
                    path, [("/alquiler_casa_", "house"), ("/alquiler_(?:piso|atico|duplex|estudio|loft)_", "flat")]
                ),
                c.infer_type(text),
            ),
            "image_urls": c.one_image(absolute_url(F.col("photo"), base)),
            "tags": c.infer_tags(text),
        }
    ).withColumn("chars", c.measure_chars(F.col("rooms"), F.col("bathrooms"), F.col("area_m2")))
    return c.finish(rows, "enalquiler")


def milanuncios(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["milanuncios"]
    article = r"""(?i)<article[^>]*class=["'][^"']*ma-AdCardV2[^"']*["'][^>]*>(?s:.*?)</article>"""
    rows = c.explode_blocks(pages, all_matches(F.col("html"), article, 0))
    block = F.col("block")
    shown = lambda tag, name: strip_tags(not_blank(first_match(block, c.inner(tag, name))))
    labels = F.transform(all_matches(block, c.inner("span", "ma-AdTag-label")), strip_tags)
    rows = rows.withColumns(
        {
            "href": F.coalesce(
                first_match(block, c.attr_of("a", "ma-AdCardListingV2-TitleLink", "href") + "[^>]*>"),
                first_match(block, r"""(?i)<a[^>]*href=["'](/(?:venta|alquiler)-de-[^"']+?\.htm)["'][^>]*>"""),
            ),
            "chars": unique_strings(labels),
            "name": shown("h2", "ma-AdCardV2-title"),
            "city": c.city_or_place(shown("span", "ma-AdLocation-text")),
            "price_raw": shown("span", "ma-AdPrice-value"),
            "description": F.coalesce(shown("p", "ma-AdCardV2-description"), F.lit("")),
            "photo": first_match(block, c.attr_of("img", "ma-AdCardV2-photo", "src") + "[^>]*>"),
        }
    ).filter("href IS NOT NULL")
    rows = rows.withColumn("url", c.full_url(F.col("href"), base))
    path = c.page_path(F.col("url"))
    rows = rows.withColumn(
        "portal_listing_id",
        F.coalesce(not_blank(F.regexp_extract(path, r"(?i)-([0-9]+)\.htm", 1)), c.slug_id(path, F.col("url"))),
    ).withColumn("title", F.coalesce("name", F.concat(F.lit("Inmueble "), F.col("portal_listing_id"))))
    text = _join(F.col("title"), F.col("description"))
    first_known = lambda values: F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))
    surface = first_known(F.transform("chars", lambda x: parse_number(first_match(x, r"(?iu)([0-9]+)\s*m²"))))
    rows = rows.withColumns(
        {
            "rooms": F.coalesce(first_known(F.transform("chars", parse_rooms)), parse_rooms(text)),
            "property_type": F.coalesce(
                c.type_by(
                    F.lower(path),
                    [
                        ("de-pisos", "flat"), ("de-casas", "house"), ("de-locales|de-oficinas", "office"),
                        ("de-solares|de-terrenos", "land"),
                    ],
                ),
                c.infer_type(text),
            ),
            "surface": surface,
            "price_eur": parse_price(F.col("price_raw")),
            "image_urls": c.one_image(absolute_url(F.col("photo"), base)),
            "tags": c.infer_tags(text),
            "price_raw": not_blank(F.col("price_raw")),
        }
    ).withColumn("capacity_people", c.office_capacity(F.col("property_type"), F.col("surface")))
    return c.finish(rows, "milanuncios")


def globaliza(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["globaliza"]
    item = r"""(?i)<li[^>]*class=["'][^"']*serp-snippet[^"']* ad[^"']*["'](?s:.*?)</li>"""
    rows = c.explode_blocks(pages, all_matches(F.col("html"), item, 0))
    block = F.col("block")
    heading = c.inner("h2", "title")
    count = lambda name, tail="": not_blank(
        F.regexp_extract(block, rf"(?i){c.open_tag('span', name)}[^>]*>([0-9]+){tail}", 1)
    )
    rows = rows.withColumn(
        "href", first_match(block, c.attr_of("a", "detail-redirection", "href") + "[^>]*>")
    ).filter("href IS NOT NULL").withColumn("url", c.full_url(F.col("href"), base))
    path = c.page_path(F.col("url"))
    photos = F.filter(
        all_matches(block, r"""(?i)(?:src|data-lazy)=["']([^"']+)["']"""),
        lambda x: ~x.rlike(r"(?i)loading-image|logo\.jpeg|logo\.png"),
    )
    rows = rows.withColumn(
        "portal_listing_id",
        F.coalesce(
            F.translate(slugify(not_blank(F.regexp_extract(path, "(?i)/inmueble/([^/?#]+)", 1))), "-", "_"),
            c.slug_id(path, F.col("url")),
        ),
    ).withColumns(
        {
            "title": c.text_of(block, heading, default=F.concat(F.lit("Inmueble "), F.col("portal_listing_id"))),
            "price_text": c.text_of(block, c.inner("div", "price")),
            "description": c.text_of(block, c.inner("p", "description")),
            "photo": F.coalesce(
                F.get(F.filter(photos, lambda x: x.rlike(r"(?i)img\.resemmedia\.com")), F.lit(0)), F.get(photos, F.lit(0))
            ),
            "bathrooms": parse_number(count("bathrooms")),
            "area": parse_number(count("areaBuilt", r"\s*m2")),
            "room_count": count("rooms"),
            "locality": not_blank(
                first_match(block, r"""(?i)<meta[^>]*itemprop=["']addressLocality["'][^>]*content=["']([^"']+)["']""")
            ),
            # ", City, Province" at the end of the heading
            "heading_city": not_blank(
                F.regexp_extract(c.text_of(block, heading), rf",{WS}*([^,]+),{WS}*[^,]+\z", 1)
            ),
        }
    )
    text = _join(F.col("title"), F.col("description"))
    rows = rows.withColumns(
        {
            "city": c.city_or_place(F.coalesce(strip_tags(F.col("locality")), trim_ws(F.col("heading_city")))),
            "rooms": F.when(F.col("room_count").isNotNull(), parse_number(F.col("room_count"))).otherwise(parse_rooms(text)),
            "price_eur": parse_price(F.col("price_text")),
            "price_raw": not_blank(F.col("price_text")),
            "property_type": F.coalesce(
                c.type_by(
                    F.lower(path),
                    [
                        ("/(?:venta|alquiler)/pisos", "flat"), ("/(?:venta|alquiler)/(?:casas|chalets)", "house"),
                        ("/(?:venta|alquiler)/oficinas", "office"), ("/(?:venta|alquiler)/terrenos", "land"),
                    ],
                ),
                c.infer_type(text),
            ),
            "image_urls": c.one_image(absolute_url(F.col("photo"), base)),
            "tags": c.infer_tags(text),
        }
    )
    rows = rows.withColumns(
        {
            "chars": c.measure_chars(F.col("rooms"), F.col("bathrooms"), F.col("area")),
            "capacity_people": c.office_capacity(F.col("property_type"), F.col("area")),
        }
    ).drop("bathrooms")
    return c.finish(rows, "globaliza")


def hogaria(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["hogaria"]
    item = r"""(?i)<div class="item col-xs-4 col-lg-4 grid-group-item"[^>]*itemprop="offers"(?s:.*?)"""
    by_marker = all_matches(
        F.col("html"), item + r"""(?=<input type="hidden" name="listado\$ctl[0-9]+\$codigo")""", 0
    )
    by_link = all_matches(F.col("html"), item + r"""<a[^>]*itemprop=['"]url['"](?s:.*?)</div>\s*</div>""", 0)
    rows = c.explode_blocks(pages, F.when(F.size(by_marker) > 0, by_marker).otherwise(by_link))
    block = F.col("block")
    prop = lambda tag, name: rf"""(?i)<{tag}[^>]*itemprop=['"]{name}['"][^>]*"""
    rows = rows.withColumn(
        "href", first_match(block, prop("a", "url") + r"""href=['"]([^"']+)['"][^>]*>""")
    ).filter("href IS NOT NULL").withColumn("url", c.full_url(F.col("href"), base))
    path = c.page_path(F.col("url"))
    photo = F.coalesce(
        first_match(block, c.attr_of("img", "ltimagen", "data-src")), first_match(block, c.attr_of("img", "ltimagen", "src"))
    )
    rows = rows.withColumn(
        "portal_listing_id",
        F.coalesce(
            not_blank(F.regexp_extract(path, r"(?i)_([0-9]+)\.aspx\z", 1)),
            not_blank(F.regexp_extract(block, r"""(?i)<a[^>]*id=['"]lnk([0-9]+)['"]""", 1)),
            c.slug_id(path, F.col("url")),
        ),
    ).withColumns(
        {
            "title": c.text_of(
                block, prop("a", "url") + r">((?s:.*?))</a>", default=F.concat(F.lit("Inmueble "), F.col("portal_listing_id"))
            ),
            "price_content": first_match(block, prop("p", "price") + r"""content=['"]([^"']+)['"]"""),
            "price_text": c.text_of(block, prop("p", "price") + r">((?s:.*?))</p>"),
            "description": c.text_of(block, prop("div", "description") + r">((?s:.*?))</div>"),
            "city": c.city_or_place(not_blank(strip_tags(not_blank(first_match(block, c.inner("h3", "h2ubicacion")))))),
            "photo": F.when(~photo.rlike("(?i)no_image"), photo),
            "area_m2": c.area_in(block, c.AREA_SIGN),
            "dorm": parse_number(first_match(block, r"(?i)([0-9]+)\s*dorm\.")),
            "bathrooms": c.bathrooms_in(block),
        }
    )
    text = _join(F.col("title"), F.col("description"))
    rows = rows.withColumns(
        {
            "chars": c.measure_chars(F.col("dorm"), F.col("bathrooms"), F.col("area_m2")),
            "rooms": F.coalesce(F.col("dorm"), parse_rooms(text)),
            "price_eur": F.coalesce(parse_number(F.col("price_content")), parse_price(F.col("price_text"))),
            "price_raw": not_blank(F.col("price_text")),
            "property_type": F.coalesce(
                c.type_by(
                    F.lower(path),
                    [
                        (rf"/(?:venta|alquiler)-piso{WE}", "flat"), (rf"/(?:venta|alquiler)-casa{WE}", "house"),
                        (rf"/(?:venta|alquiler)-oficina{WE}", "office"),
                        (rf"/(?:venta|alquiler)-terrenos_solares{WE}", "land"),
                        ("/locales-oficinas-naves/", "office"), ("/terrenos-solares/", "land"),
                    ],
                ),
                c.infer_type(_join(text, path)),
                F.col("requested_type"),
            ),
            "image_urls": c.one_image(absolute_url(F.col("photo"), base)),
            "tags": c.infer_tags(text),
        }
    ).withColumn("capacity_people", c.office_capacity(F.col("property_type"), F.col("area_m2")))
    return c.finish(rows, "hogaria")


def pisocompartido(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["pisocompartido"]
    card = r"""<div id="h[0-9]+" class="\s*card">"""
    whole = rf"""(?i){card}(?s:.*?)(?={card}|<div class="cCardsFooter"|<script id="subscribedataLayer"|</body>)"""
    rows = c.explode_blocks(pages, all_matches(F.col("html"), whole, 0))
    block = F.col("block")
    rows = rows.withColumns(
        {
            "portal_listing_id": first_match(block, r"""(?i)<div id="h([0-9]+)" class="\s*card">"""),
            "href": first_match(block, c.attr_of("a", "linkCard", "href")),
            "title": c.text_of(block, r"""(?i)<h6 class="textoTipo">((?s:.*?))</h6>""", default="Habitación"),
            "price_html": F.coalesce(first_match(block, r"""(?i)<span class="contPrecio">((?s:.*?))</span>"""), F.lit("")),
            "place": c.text_of(block, r"""(?i)<div class="contLocalizacion">\s*<h5>((?s:.*?))</h5>"""),
            "docs": F.filter(
                F.transform(
                    all_matches(block, r"""(?i)<script type="application/ld\+json">((?s:.*?))</script>"""),
                    lambda t: F.try_parse_json(t),
                ),
                lambda v: v.isNotNull(),
            ),
        }
    ).filter("href IS NOT NULL AND portal_listing_id IS NOT NULL")

    def nodes(doc: Column) -> Column:
        graph = member(doc, "$['@graph']")
        return F.when(is_array(graph), F.try_variant_get(doc, "$['@graph']", "array<variant>")).otherwise(F.array(doc))

    def of_type(doc: Column, name: str) -> Column:
        return F.get(F.filter(nodes(doc), lambda n: F.coalesce(raw_string(n, "$['@type']") == name, F.lit(False))), F.lit(0))

    def photos(doc: Column) -> Column:
        residence = of_type(doc, "Residence")
        listed = F.transform(
            F.coalesce(F.try_variant_get(residence, "$.photo", "array<variant>"), F.array().cast("array<variant>")),
            lambda p: raw_string(p, "$.contentUrl"),
        )
        return F.array_compact(F.concat(F.array(raw_string(of_type(doc, "Product"), "$.image")), listed))

    def first_of(read) -> Column:
        return F.get(F.filter(F.transform("docs", read), lambda x: x.isNotNull()), F.lit(0))

    def described(doc: Column) -> Column:
        product, residence = of_type(doc, "Product"), of_type(doc, "Residence")
        return not_blank(
            strip_tags(F.coalesce(F.try_variant_get(product, "$.description", "string"), F.try_variant_get(residence, "$.description", "string")))
        )

    rows = rows.withColumns(
        {
            "url": c.full_url(F.col("href"), base),
            "description": F.coalesce(first_of(described), F.lit("")),
            "ld_city": first_of(lambda d: not_blank(strip_tags(raw_string(of_type(d, "Residence"), "$.address.addressLocality")))),
            "lat": first_of(lambda d: number(of_type(d, "Residence"), "$.geo.latitude")),
            "lon": first_of(lambda d: number(of_type(d, "Residence"), "$.geo.longitude")),
            "ld_images": F.transform(F.flatten(F.transform("docs", photos)), lambda u: absolute_url(u, base)),
            "card_images": F.transform(
                F.filter(
                    all_matches(block, r"""(?i)data-lazybg=["']([^"']+)["']"""), lambda u: ~u.rlike(r"(?i)/css/img/1x1\.png")
                ),
                lambda u: absolute_url(u, base),
            ),
        }
    )
    text = _join(F.col("title"), F.col("description"))
    is_room = F.col("title").rlike("(?iu)habitaci[oó]n")
    rows = rows.withColumns(
        {
            "city": F.coalesce(not_blank(F.col("place")), c.city_or_place(F.col("ld_city"))),
            "property_type": F.coalesce(c.infer_type(text), F.when(is_room, "flat")),
            "rooms": F.when(is_room, F.lit(1.0)).otherwise(parse_rooms(_join(text, F.col("place")))),
            "image_urls": unique_strings(F.concat("card_images", "ld_images")),
            "price_eur": parse_price(F.col("price_html")),
            "price_raw": F.when(F.col("price_html") != "", strip_tags(F.col("price_html"))),
            "tags": c.infer_tags(_join(text, F.col("place"))),
        }
    ).withColumn(
        "chars",
        F.array_compact(
            F.array(
                F.concat(c.number_text(F.col("rooms")), F.lit(" hab.")),
                F.when(F.col("title").rlike(r"(?iu)habitaci[oó]n\s+doble"), F.lit("Habitación doble")),
            )
        ),
    )
    return c.finish(rows, "pisocompartido")


__all__ = [
    "habitaclia", "nuroa", "spainhouses", "enalquiler", "milanuncios", "globaliza", "hogaria", "pisocompartido",
]
