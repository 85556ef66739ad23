"""Portals whose pages carry JSON, alone or beside HTML cards, and the two-step portal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost import rules
from roost.functions.json import (
    is_array, is_object, member, number, object_or_null, raw_string, string,
    with_item_list_elements,
)
from roost.functions.numbers import parse_number, parse_price, parse_rooms
from roost.functions.text import (
    WE, WS, all_matches, decode_entities, first_match, not_blank, slugify, strip_closed_tags, strip_tags, trim_ws,
    unique_strings,
)
from roost.functions.urls import absolute_url, query_value
from roost.operators.portals import common as c
from roost.operators.portals.cards import _join

MEDIA_BASE = "https://media.yaencontre.com/"


def _inmueble(listing_id: Column) -> Column:
    return F.concat(F.lit("Inmueble "), listing_id)


def _own_or_inner(element: Column) -> Column:
    """The ``item`` object of a list element, else the element itself."""
    return F.coalesce(object_or_null(member(element, "$.item")), element)


def _with_items(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD list element: ``element`` and its ``item``."""
    found = with_item_list_elements(pages.select(*c.PAGE_KEYS, "html"), "html", "blocks")
    rows = c.explode_blocks(found, F.col("blocks")).withColumn("element", F.try_parse_json("block"))
    return rows.withColumn("item", _own_or_inner(F.col("element")))


def tucasa(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["tucasa"]
    rows = _with_items(pages)
    item = F.col("item")
    rows = rows.withColumn("href", F.coalesce(string(item, "$.url"), string(F.col("element"), "$.url"))).filter("href IS NOT NULL")
    rows = rows.withColumn("url", c.full_url(F.col("href"), base))
    path, query_id = c.page_path(F.col("url")), query_value(F.col("url"), "id")
    rows = rows.withColumn(
        "portal_listing_id",
        F.coalesce(
            F.when(query_id.rlike(r"^[0-9]+\z"), query_id),
            not_blank(F.regexp_extract(path, rf"(?i)/(?:id_a)?([0-9]{{6,}}){WE}", 1)),
            c.slug_id(path, F.col("url")),
        ),
    )
    plain_city = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, rf"{WS}*\([^)]*\){WS}*", " "), f"{WS}+", " "))
    image = member(item, "$.image")
    rows = rows.withColumns(
        {
            "title": F.coalesce(string(item, "$.name", "$.title"), _inmueble(F.col("portal_listing_id"))),
            "description": strip_tags(F.coalesce(string(item, "$.description"), F.lit(""))),
            "image_urls": F.when(
                is_array(image),
                F.array_compact(F.transform(F.try_variant_get(item, "$.image", "array<variant>"), lambda v: string(v, "$"))),
            ).otherwise(c.one_image(string(item, "$.image"))),
            "price_raw": string(item, "$.offers.price"),
            "price_eur": F.coalesce(number(item, "$.offers.price"), parse_price(string(item, "$.offers.price"))),
            "schema_rooms": parse_number(string(item, "$.mainEntity.numberOfRooms", "$.mainEntity.numBedrooms")),
            "floor_size": parse_number(string(item, "$.mainEntity.floorSize.value")),
            "city": F.coalesce(
                plain_city(F.coalesce(string(item, "$.mainEntity.address.addressLocality"), string(item, "$.name", "$.title"))),
                F.lit("Unknown"),
            ),
        }
    )
    text = _join(F.col("title"), F.col("description"))
    rows = rows.withColumns(
        {
            "rooms": F.coalesce(F.col("schema_rooms"), parse_rooms(text)),
            "property_type": F.coalesce(
                c.type_by(
                    F.lower(path),
                    [
                        ("/pisos-y-apartamentos/", "flat"), ("/casas-y-chalets/", "house"), ("/oficinas/", "office"),
                        ("/terrenos/|/solares/", "land"),
                    ],
                ),
                c.infer_type(text),
            ),
            "tags": c.infer_tags(F.col("description")),
        }
    )
    rows = rows.withColumns(
        {
            "chars": c.measure_chars(F.col("rooms"), area=F.col("floor_size")),
            "capacity_people": c.office_capacity(F.col("property_type"), F.col("floor_size")),
        }
    )
    return c.finish(rows, "tucasa")


# -- yaencontre: page state, else list data, else bare links ------------------------------

def _window_json(html: Column, name: str) -> Column:
    """Text of ``window.<name> = JSON.parse(atob("..."))``; null when absent or no JSON."""
    payload = first_match(html, rf"""(?i)window\.{name}\s*=\s*JSON\.parse\(atob\((["'])((?s:.*?))\1\)\)""", 2)
    text = F.try_to_binary(payload, F.lit("base64"))
    decoded = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))
    return F.when(F.try_parse_json(decoded).isNotNull(), decoded)


def _state_items(html: Column) -> Column:
    """Entries of the result map in the order a browser lists them: number keys first."""
    state = F.from_json(
        _window_json(html, "__INITIAL_STATE__"),
        "struct<results:struct<currentPageItems:struct<byId:map<string,string>>>>",
        {"allowSingleQuotes": "false"},
    )
    entries = F.map_entries(state["results"]["currentPageItems"]["byId"])
    number_key = lambda e: F.when(e["key"].rlike(r"^(?:0|[1-9][0-9]{0,8})\z"), e["key"].try_cast("bigint"))
    keyed = F.transform(
        entries,
        lambda e, i: F.struct(
            number_key(e).isNull().alias("named"), F.coalesce(number_key(e), i.cast("bigint")).alias("at"), e["value"].alias("text")
        ),
    )
    texts = F.transform(F.array_sort(keyed), lambda e: e["text"])
    usable = F.filter(
        texts, lambda t: string(_own_or_inner(F.try_parse_json(t)), "$.url").isNotNull()
    )
    return F.coalesce(usable, F.array().cast("array<string>"))


def _image_strings(v: Column, base: str) -> Column:
    """Links of an image value: text, object with a link, or a list of either."""
    one = lambda x: F.coalesce(string(x, "$"), string(x, "$.url", "$.contentUrl", "$.thumbnailUrl"))
    many = F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    links = F.filter(F.transform(many, one), lambda x: x.isNotNull())
    return F.coalesce(unique_strings(F.transform(links, lambda x: absolute_url(x, base))), F.array().cast("array<string>"))


def yaencontre(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["yaencontre"]
    found = with_item_list_elements(pages.select(*c.PAGE_KEYS, "html"), "html", "listed")
    anchors = F.filter(
        all_matches(F.col("html"), r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>"""),
        lambda h: (h.rlike("^/(?:venta|alquiler)/") | h.rlike(r"(?i)^https?://www\.yaencontre\.com/(?:venta|alquiler)/"))
        & h.rlike("(?i)inmueble-[0-9]{5,}"),
    )
    usable_list = F.filter(
        F.col("listed"),
        lambda t: F.coalesce(
            string(_own_or_inner(F.try_parse_json(t)), "$.url"), string(F.try_parse_json(t), "$.url")
        ).isNotNull(),
    )
    found = found.withColumns(
        {
            "state": _state_items(F.col("html")),
            "listed": usable_list,
            "links": unique_strings(F.transform(anchors, lambda h: absolute_url(h, base))),
            "media": F.coalesce(string(F.try_parse_json(_window_json(F.col("html"), "JHT")), "$.MEDIA_URL"), F.lit(MEDIA_BASE)),
        }
    )
    tier = F.when(F.size("state") > 0, 0).when(F.size("listed") > 0, 1).otherwise(2)
    chosen = F.when(F.size("state") > 0, F.col("state")).when(F.size("listed") > 0, F.col("listed")).otherwise(F.col("links"))
    rows = c.explode_blocks(found, chosen, tier.alias("tier_no"), F.col("media"))
    rows = rows.withColumn("element", F.when(F.col("tier_no") < 2, F.try_parse_json("block"))).withColumn(
        "item", _own_or_inner(F.col("element"))
    )
    item, is_state, is_list = F.col("item"), F.col("tier_no") == 0, F.col("tier_no") == 1
    rows = rows.withColumn(
        "url",
        c.full_url(
            F.when(F.col("tier_no") == 2, F.col("block")).otherwise(
                F.coalesce(string(item, "$.url"), string(F.col("element"), "$.url"))
            ),
            base,
        ),
    )
    path, query_id = c.page_path(F.col("url")), query_value(F.col("url"), "id")
    reference = F.when(is_state, string(item, "$.reference", "$.id"))
    rows = rows.withColumn(
        "portal_listing_id",
        F.coalesce(
            F.translate(slugify(reference), "-", "_"),
            F.when(query_id.rlike(r"^[0-9]+\z"), query_id),
            not_blank(F.regexp_extract(path, "([0-9]{6,})", 1)),
            c.slug_id(path, F.col("url")),
        ),
    )
    named = F.when(is_state, string(item, "$.title", "$.name")).otherwise(string(item, "$.name", "$.title"))
    state_images = F.transform(
        F.filter(
            F.transform(
                F.coalesce(F.try_variant_get(item, "$.images", "array<variant>"), F.array().cast("array<variant>")),
                lambda v: F.coalesce(string(v, "$.slug", "$.url"), string(v, "$")),
            ),
            lambda x: x.isNotNull(),
        ),
        lambda x: F.when(x.rlike("(?i)^https?://"), x)
        .when(F.startswith(x, F.lit("//")), F.concat(F.lit("https:"), x))
        .when(F.startswith(x, F.lit("/")), F.concat(F.regexp_extract("media", "^(https?://[^/]+)", 1), x))
        .otherwise(F.concat(F.regexp_replace("media", r"(?<![:/])/[^/]*\z", ""), F.lit("/"), x)),
    )
    rows = rows.withColumns(
        {
            "title": F.coalesce(named, _inmueble(F.col("portal_listing_id"))),
            "description": strip_tags(F.coalesce(string(item, "$.description"), F.lit(""))),
            "offer_price": string(item, "$.offers.price"),
            "bathrooms": F.when(is_state, number(item, "$.bathrooms")),
            "area": F.when(is_state, number(item, "$.area")),
            "lat0": F.when(is_state, number(item, "$.address.geoLocation.lat")),
            "lon0": F.when(is_state, number(item, "$.address.geoLocation.lon")),
            "city": c.city_or_place(
                F.when(
                    is_state,
                    not_blank(trim_ws(F.get(F.split(string(item, "$.address.qualifiedName"), ","), F.lit(0)))),
                ).otherwise(string(item, "$.address.addressLocality", "$.mainEntity.address.addressLocality"))
            ),
            "image_urls": F.when(is_state, unique_strings(state_images)).otherwise(
                _image_strings(member(item, "$.image"), base)
            ),
        }
    )
    text = _join(F.col("title"), F.col("description"))
    family = F.upper(string(item, "$.family"))
    by_family = c.type_by(
        family,
        [
            ("FLAT|APARTMENT|PENTHOUSE|DUPLEX|LOFT|STUDIO", "flat"), ("HOUSE|CHALET|VILLA|RURAL|TOWNHOUSE", "house"),
            ("OFFICE|LOCAL|COMMERCIAL", "office"), ("LAND|PLOT|SOIL|SOLAR|RUSTIC", "land"),
        ],
    )
    has_data = F.col("tier_no") < 2
    rows = rows.withColumns(
        {
            "price_eur": F.when(
                is_state, F.coalesce(number(item, "$.price"), parse_price(string(item, "$.price")))
            ).otherwise(F.coalesce(number(item, "$.offers.price"), parse_price(F.col("offer_price")))),
            "price_raw": F.when(is_list, F.col("offer_price")),
            "rooms": F.when(
                has_data,
                F.coalesce(
                    F.when(is_state, number(item, "$.rooms")).otherwise(
                        number(item, "$.numberOfRooms", "$.numBedrooms", "$.mainEntity.numberOfRooms")
                    ),
                    parse_rooms(text),
                ),
            ),
            "property_type": F.when(has_data, F.coalesce(F.when(is_state, by_family), c.infer_type(text))),
            "tags": F.when(has_data, c.infer_tags(text)).otherwise(F.array().cast("array<string>")),
            "lat": F.when(F.col("lon0").isNotNull(), F.col("lat0")),
            "lon": F.when(F.col("lat0").isNotNull(), F.col("lon0")),
        }
    )
    rows = rows.withColumns(
        {
            "chars": c.measure_chars(F.col("rooms"), F.col("bathrooms"), F.col("area")),
            "capacity_people": F.when(is_state, c.office_capacity(F.col("property_type"), F.col("area"))),
        }
    ).drop("bathrooms")
    return c.finish(rows, "yaencontre")


# -- idealista: list data, then articles, then list items; first wins ---------------------

def _room_and_area(text: Column) -> Column:
    area = not_blank(F.regexp_extract(text, r"(?iu)([0-9]{1,4})\s*m²", 1))
    return F.array_compact(
        F.array(F.concat(c.number_text(parse_rooms(text)), F.lit(" habs.")), F.concat(area, F.lit(" m²")))
    )


def idealista(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["idealista"]
    found = with_item_list_elements(pages.select(*c.PAGE_KEYS, "html"), "html", "listed")
    mark = lambda arr, n: F.transform(arr, lambda t: F.struct(F.lit(n).alias("kind"), t.alias("text")))
    blocks = F.concat(
        mark(F.col("listed"), 0),
        mark(all_matches(F.col("html"), r"(?i)<article(?s:.*?)</article>", 0), 1),
        mark(all_matches(F.col("html"), r"""(?i)<li[^>]*class=["'][^"']*item[^"']*["'](?s:.*?)</li>""", 0), 2),
    )
    rows = c.explode_blocks(found, blocks).select(*c.PAGE_KEYS, "block_no", F.col("block.kind").alias("kind"), F.col("block.text").alias("block"))
    is_json, block = F.col("kind") == 0, F.col("block")
    rows = rows.withColumn("item", F.when(is_json, _own_or_inner(F.try_parse_json("block"))))
    item = F.col("item")
    rows = rows.withColumn(
        "href", F.when(is_json, string(item, "$.url")).otherwise(first_match(block, r"""(?i)href=["'](/inmueble/[0-9]+/?)["']"""))
    ).filter("href IS NOT NULL").withColumn("url", c.full_url(F.col("href"), base))
    path = c.page_path(F.col("url"))
    rows = rows.withColumn(
        "portal_listing_id",
        F.coalesce(not_blank(F.regexp_extract(path, "(?i)/inmueble/([0-9]+)", 1)), c.slug_id(path, F.col("url"))),
    )
    heading = strip_tags(
        F.coalesce(
            first_match(block, r"(?i)<h2[^>]*>((?s:.*?))</h2>"),
            first_match(block, r"""(?i)<a[^>]*href=["']/inmueble/[0-9]+/?["'][^>]*>((?s:.*?))</a>"""),
        )
    )
    photo = F.coalesce(
        first_match(block, r"""(?i)<img[^>]*src=["']([^"']+)["'][^>]*>"""),
        first_match(block, r"""(?i)<meta[^>]*property=["']og:image["'][^>]*content=["']([^"']+)["']"""),
    )
    price_text = strip_tags(
        F.coalesce(
            first_match(block, rf"(?i)([0-9](?:[0-9.]|{WS})*+€)"),
            first_match(block, r"""(?i)<span[^>]*class=["'][^"']*price[^"']*["'][^>]*>((?s:.*?))</span>"""),
            F.lit(""),
        )
    )
    rows = rows.withColumns(
        {
            "title": F.coalesce(
                F.when(is_json, string(item, "$.name", "$.title")).otherwise(not_blank(heading)),
                _inmueble(F.col("portal_listing_id")),
            ),
            "description": F.when(is_json, strip_tags(F.coalesce(string(item, "$.description"), F.lit("")))).otherwise(
                c.text_of(block, r"(?i)<p[^>]*>((?s:.*?))</p>")
            ),
            "city": c.city_or_place(
                F.when(is_json, string(item, "$.address.addressLocality")).otherwise(
                    not_blank(c.text_of(block, r"(?i)<address[^>]*>((?s:.*?))</address>"))
                )
            ),
            "price_text": F.when(~is_json, price_text),
            "image_urls": c.one_image(absolute_url(F.when(is_json, string(item, "$.image")).otherwise(photo), base)),
        }
    )
    text = _join(F.col("title"), F.col("description"))
    full = F.when(is_json, text).otherwise(_join(text, block))
    area = F.when(~is_json, parse_number(not_blank(F.regexp_extract(full, r"(?iu)([0-9]{1,4})\s*m²", 1))))
    rows = rows.withColumns(
        {
            "price_eur": F.when(
                is_json, F.coalesce(number(item, "$.offers.price"), parse_price(string(item, "$.offers.price")))
            ).otherwise(parse_price(F.col("price_text"))),
            "price_raw": not_blank(F.col("price_text")),
            "rooms": F.coalesce(F.when(is_json, number(item, "$.numberOfRooms", "$.numBedrooms")), parse_rooms(full)),
            "property_type": F.coalesce(
                c.type_by(
                    F.lower(path),
                    [("/pisos/", "flat"), ("/casas-chalets/|/casas/", "house"), ("/oficinas/", "office"), ("/terrenos/", "land")],
                ),
                c.infer_type(text),
            ),
            "tags": c.infer_tags(text),
            "chars": _room_and_area(full),
            "area": area,
        }
    ).withColumn("capacity_people", c.office_capacity(F.col("property_type"), F.col("area")))
    return c.finish(rows, "idealista")


# -- fotocasa: result cards, overridden by detail pages -----------------------------------

def _path_id(path: Column, url: Column) -> Column:
    return F.coalesce(not_blank(F.regexp_extract(path, r"/([0-9]+)/d(?:\z|[/?#])", 1)), c.slug_id(path, url))


def _path_city(path: Column) -> Column:
    token = not_blank(F.regexp_extract(path, "(?i)/vivienda/([^/]+)/", 1))
    return F.coalesce(c.title_words(token, "-"), F.lit("Unknown"))


def _meta(html: Column, key: str) -> Column:
    return strip_tags(
        not_blank(
            first_match(html, rf"""(?i)<meta[^>]+(?:property|name)=["']{key}["'][^>]+content=["']([^"']+)["'][^>]*>""")
        )
    )


DETAIL_PATH = r"^/es/(?:comprar|alquilar)/vivienda/[^\"'\s]+?/[0-9]+/d"


def fotocasa(pages: DataFrame) -> DataFrame:
    """Cards of search pages and rows of detail pages; a detail row replaces its card (lower tier wins)."""
    base = rules.PORTAL_URLS["fotocasa"]
    is_detail = F.coalesce(F.col("path").rlike(DETAIL_PATH), F.lit(False))
    link = r"""href=["'](/es/(?:comprar|alquilar)/vivienda/[^"']+?/[0-9]+/d)(?:\?[^"']*)?["']"""
    cards = c.explode_blocks(
        pages.filter(~is_detail), all_matches(F.col("html"), rf"(?i)<article(?s:.*?){link}(?s:.*?)</article>", 0)
    )
    block = F.col("block")
    cards = cards.withColumn("url", c.full_url(first_match(block, f"(?i){link}"), base))
    path = c.page_path(F.col("url"))
    flat = strip_tags(block)
    cards = cards.withColumns(
        {
            "portal_listing_id": _path_id(path, F.col("url")),
            "city": _path_city(path),
            "flat": flat,
            "heading": F.coalesce(
                strip_tags(not_blank(first_match(block, r"(?i)<h3[^>]*>(?s:.*?)<span>((?s:.*?))</span>(?s:.*?)</h3>"))),
                strip_tags(not_blank(first_match(block, r"(?i)<h3[^>]*>((?s:.*?))</h3>"))),
            ),
            "photo": first_match(block, r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*>"""),
        }
    )
    cards = cards.withColumns(
        {
            "title": F.coalesce("heading", F.concat(F.lit("Vivienda "), F.col("portal_listing_id"))),
            "price_eur": parse_price(first_match(F.col("flat"), r"([0-9.]+)\s*€")),
            "rooms": parse_rooms(F.col("flat")),
            "description": F.lit(""),
            "image_urls": c.one_image(absolute_url(F.col("photo"), base)),
        }
    )
    cards = cards.withColumns(
        {"property_type": c.infer_type(F.col("title")), "tags": c.infer_tags(F.col("title")), "chars": c.measure_chars(F.col("rooms"))}
    )

    html = F.col("html")
    details = pages.filter(is_detail).select(
        *c.PAGE_KEYS,
        F.lit(0).alias("block_no"),
        c.full_url(
            F.coalesce(
                not_blank(first_match(html, r"""(?i)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)["'][^>]*>""")),
                F.concat(F.lit(base), F.col("path")),
            ),
            base,
        ).alias("url"),
        _meta(html, "og:title").alias("heading"),
        F.coalesce(_meta(html, "og:description"), F.lit("")).alias("description"),
        _meta(html, "og:image").alias("photo"),
        F.coalesce(
            parse_price(
                not_blank(first_match(html, r"""(?i)class=["'][^"']*re-DetailHeader-price[^"']*["'][^>]*>([^<]+)<"""))
            ),
            parse_price(first_match(html, r'(?i)"price"\s*:\s*"?([0-9][0-9.,]*)"?')),
        ).alias("price_eur"),
    )
    details = details.withColumns(
        {
            "portal_listing_id": _path_id(c.page_path(F.col("url")), F.col("url")),
            "city": _path_city(c.page_path(F.col("url"))),
        }
    ).withColumn("title", F.coalesce("heading", F.concat(F.lit("Vivienda "), F.col("portal_listing_id"))))
    text = _join(F.col("title"), F.col("description"))
    details = details.withColumns(
        {
            "rooms": parse_rooms(text),
            "property_type": c.infer_type(text),
            "tags": c.infer_tags(F.col("description")),
            "image_urls": c.one_image(not_blank(F.col("photo"))),
        }
    ).withColumn("chars", c.measure_chars(F.col("rooms")))
    return c.finish(details, "fotocasa", tier=F.lit(0)).unionByName(c.finish(cards, "fotocasa", tier=F.lit(1)))


# -- pisos: API payload; cards, else one JSON-LD object per listing -----------------------

# Fixed values of this portal's own, slightly different text rules.
PISOS_ENTITIES = [("euro", "EUR")]
PISOS_TYPES = [
    ("piso|flat|apart|atico", "flat"),
    ("casa|house|chalet|villa|adosada|pareada", "house"),
    ("oficina|office", "office"),
    ("suelo|land|solar|terreno|plot", "land"),
]
PISOS_TAGS = [
    (t, p.replace("|countryside)", "|countryside|beachfront)") if t == "nature" else p) for t, p in rules.TAG_PATTERNS
]
PAYLOAD_KEYS = ["inmuebles", "items", "results", "listings", "data", "properties"]
IMAGE_KEYS = ["images", "fotos", "multimedia", "media", "gallery"]
BLOCKED_PATHS = ["/WS/", "/mapa/", "/Grid/GetAdsense", "/JSLogger/TraceError"]


def allowed_path(path: Column) -> Column:
    """Paths the portal lets a reader fetch."""
    out = ~path.rlike(r"(?i)\.aspx(?:\z|[/?#])")
    for fragment in BLOCKED_PATHS:
        out = out & ~F.contains(path, F.lit(fragment))
    return out


def _pisos_text(c0: Column) -> Column:
    return strip_closed_tags(c0, PISOS_ENTITIES)


def _pisos_capacity(description: Column, chars: Column) -> Column:
    joined = _join(description, F.array_join(chars, " "))
    people = not_blank(F.regexp_extract(joined, r"(?i)([0-9]+)\s*(?:personas|people|puestos?)", 1)).try_cast("double")
    area = not_blank(F.regexp_extract(joined, r"(?iu)([0-9]+)\s*m²", 1)).try_cast("double")
    return F.coalesce(people, F.floor(area / 2.5).cast("double"))


def _pisos_canonical() -> Column:
    return F.concat(F.lit("pisos-"), F.regexp_replace("portal_listing_id", "[^a-zA-Z0-9_-]", "_"))


def pisos(pages: DataFrame) -> DataFrame:
    base = rules.PORTAL_URLS["pisos"]
    card = r"""<div id="[^"]+" class="ad-preview(?s:.*?)</script>\s*</div>"""
    card_id = r'<div id="([^"]+)" class="ad-preview'
    card_link = r'<a href="([^"]+)" class="ad-preview__title">((?s:.*?))</a>'
    cards = F.filter(
        all_matches(F.col("html"), card, 0),
        lambda b: b.rlike(card_id) & (F.coalesce(first_match(b, card_link, 2), F.lit("")) != ""),
    )

    def usable(doc: Column) -> Column:
        v = F.try_parse_json(doc)
        return is_object(v) & F.coalesce(raw_string(v, "$.url").rlike("/comprar/|/alquiler/"), F.lit(False))

    docs = F.filter(
        F.transform(
            all_matches(F.col("html"), r'<script type="application/ld\+json">((?s:.*?))</script>'),
            lambda t: trim_ws(decode_entities(t, PISOS_ENTITIES)),
        ),
        lambda t: F.startswith(t, F.lit("{")) & F.contains(t, F.lit('"url"')) & usable(t),
    )
    found = pages.select(*c.PAGE_KEYS, cards.alias("cards"), docs.alias("docs"))
    has_cards = F.size("cards") > 0
    rows = c.explode_blocks(
        found, F.when(has_cards, F.col("cards")).otherwise(F.col("docs")), (~has_cards).alias("is_doc")
    )
    is_doc, block = F.col("is_doc"), F.col("block")
    rows = rows.withColumn("doc", F.when(is_doc, F.try_parse_json("block")))
    doc = F.col("doc")
    photo = F.coalesce(raw_string(doc, "$.image"), raw_string(doc, "$.photo.contentUrl"), raw_string(doc, "$.photo.url"))
    rows = rows.withColumns(
        {
            "href": F.when(is_doc, raw_string(doc, "$.url")).otherwise(first_match(block, card_link, 1)),
            "doc_title": F.coalesce(raw_string(doc, "$.name"), raw_string(doc, "$.description"), F.lit("Listing")),
            "doc_text": F.coalesce(raw_string(doc, "$.description"), raw_string(doc, "$.name"), F.lit("")),
            "chars0": F.transform(all_matches(block, r'<p class="ad-preview__char p-sm">((?s:.*?))</p>'), _pisos_text),
            "price_text": F.when(~is_doc, _pisos_text(F.coalesce(first_match(block, r'<span class="ad-preview__price">((?s:.*?))</span>'), F.lit("")))),
        }
    )
    rows = rows.withColumns(
        {
            "portal_listing_id": F.when(is_doc, F.coalesce(raw_string(doc, "$['@id']"), F.col("href"))).otherwise(
                first_match(block, card_id)
            ),
            "url": c.full_url(F.col("href"), base),
            "title": F.when(is_doc, _pisos_text(F.col("doc_title"))).otherwise(_pisos_text(first_match(block, card_link, 2))),
            "city": _pisos_text(
                F.when(
                    is_doc, F.coalesce(raw_string(doc, "$.address.addressLocality"), raw_string(doc, "$.address.addressRegion"))
                ).otherwise(first_match(block, r'<p class="p-sm ad-preview__subtitle">((?s:.*?))</p>'))
            ),
            "card_text": _pisos_text(F.coalesce(first_match(block, r'<p class="ad-preview__description">((?s:.*?))</p>'), F.lit(""))),
            "chars": F.when(~is_doc, F.col("chars0")),
            "image_urls": F.when(is_doc, c.one_image(photo)).otherwise(
                F.array_distinct(all_matches(block, r'(?:src|data-src)="(https://fotos\.imghs\.net/[^"]+)"'))
            ),
        }
    )
    no_chars = F.array().cast("array<string>")
    own_type = F.coalesce(
        F.col("requested_type"),
        c.type_by(
            F.lower(F.when(is_doc, F.col("doc_title")).otherwise(_join(F.col("title"), F.col("href"), F.col("card_text")))),
            PISOS_TYPES,
        ),
    )
    room_text = F.get(F.filter("chars0", lambda x: x.rlike(r"(?i)[0-9]+\s*habs?")), F.lit(0))
    rows = rows.withColumns(
        {
            "city": F.coalesce("city", F.lit("Unknown")),
            "description": F.when(is_doc, _pisos_text(F.col("doc_text"))).otherwise(F.col("card_text")),
            "price_eur": parse_price(F.col("price_text")),
            "price_raw": F.col("price_text"),
            "rooms": F.when(is_doc, number(doc, "$.numberOfRooms")).otherwise(
                not_blank(F.regexp_extract(room_text, r"(?i)([0-9]+)\s*habs?", 1)).try_cast("double")
            ),
            "property_type": own_type,
            "tags": c.infer_tags(F.when(is_doc, F.col("doc_text")).otherwise(F.col("card_text")), PISOS_TAGS),
            "capacity_people": F.when(is_doc, _pisos_capacity(F.col("doc_text"), no_chars)).otherwise(
                _pisos_capacity(F.col("card_text"), F.col("chars0"))
            ),
            "source_path": F.col("path"),
        }
    )
    return c.finish(rows, "pisos", canonical=_pisos_canonical())


def payload_items(payload: Column) -> Column:
    """Listing array of an API payload: the payload itself, or the first known key, one level nested at most."""
    out = [F.when(is_array(payload), F.try_variant_get(payload, "$", "array<variant>"))]
    for key in PAYLOAD_KEYS:
        value = member(payload, f"$.{key}")
        out.append(F.when(is_array(value), F.try_variant_get(payload, f"$.{key}", "array<variant>")))
        for nested in PAYLOAD_KEYS:
            inner = member(value, f"$.{nested}")
            out.append(F.when(is_object(value) & is_array(inner), F.try_variant_get(value, f"$.{nested}", "array<variant>")))
    return F.coalesce(*out)


def _first(v: Column, *keys: str) -> Column:
    return F.coalesce(*[raw_string(v, f"$.{k}") for k in keys])


def api_listings(payloads: DataFrame) -> DataFrame:
    """Rows of stored API responses (``crawl_location``, ``page_no``, ``path``, ``fetched_at``, ``payload`` text)."""
    rows = payloads.select(
        "crawl_location", "page_no", "path", "fetched_at",
        F.posexplode_outer(payload_items(F.try_parse_json("payload"))).alias("block_no", "v"),
    ).filter("v IS NOT NULL")
    v = F.col("v")

    def images(key: str) -> Column:
        listed = F.transform(
            F.when(is_array(member(v, f"$.{key}")), F.try_variant_get(v, f"$.{key}", "array<variant>")),
            lambda x: F.coalesce(raw_string(x, "$"), _first(x, "url", "link", "src", "href", "contentUrl")),
        )
        found = F.filter(listed, lambda x: x.isNotNull())
        return F.when(F.size(found) > 0, found)

    position = (F.col("block_no") + 1).cast("string")
    rows = rows.withColumn(
        "portal_listing_id", F.coalesce(_first(v, "id", "idInmueble", "IdInmueble", "propertyId", "codigo"), position)
    )
    listing_id = F.col("portal_listing_id")
    num = lambda *keys: number(v, *[f"$.{k}" for k in keys])
    rows = rows.withColumns(
        {
            "title": F.coalesce(
                _first(v, "title", "titulo", "name", "headline", "descripcionCorta"), F.concat(F.lit("Listing "), listing_id)
            ),
            "city": F.coalesce(_first(v, "city", "ciudad", "municipio", "location", "poblacion"), F.lit("Unknown")),
            "price_eur": num("price", "precio", "importe", "priceEur"),
            "rooms": num("rooms", "habitaciones", "dormitorios"),
            "url": F.coalesce(
                _first(v, "url", "link", "urlDetalle", "href"),
                F.concat(F.lit(rules.PORTAL_URLS["pisos"] + "/inmueble/"), listing_id, F.lit("/")),
            ),
            "property_type": c.type_by(F.lower(_first(v, "propertyType", "tipoInmueble", "type")), PISOS_TYPES),
            "description": F.coalesce(_first(v, "description", "descripcion", "texto", "detalle"), F.lit("")),
            "capacity_people": num("capacityPeople", "capacity", "aforo"),
            "image_urls": F.coalesce(*[images(k) for k in IMAGE_KEYS], F.array().cast("array<string>")),
            "chars": F.try_variant_get(v, "$.chars", "array<string>"),
            "source_path": raw_string(v, "$.source_path"),
            "raw": F.to_json(v),
            "lat": F.coalesce(*[number(v, f"$.{k}") for k in ("lat", "latitude", "geo_lat", "location_lat")]),
            "lon": F.coalesce(*[number(v, f"$.{k}") for k in ("lng", "lon", "longitude", "geo_lng", "location_lng")]),
        }
    ).withColumn("tags", c.infer_tags(F.col("description"), PISOS_TAGS))
    return c.finish(rows, "pisos", canonical=_pisos_canonical())
