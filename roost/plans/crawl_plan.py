"""From planned tasks to the list of pages a collector has to fetch.

Route tables are fixed values and small; everything is row-local array work on the task
table, exploded once. No shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost import rules
from roost.functions.numbers import parse_number
from roost.functions.text import all_matches, normalize_text, slugify, unique_strings
from roost.operators.outcomes import POLICIES
from roost.operators.portals.common import full_url, page_path
from roost.operators.portals.structured import allowed_path

# Path words per property type, and the words used when no type is asked for.
RESOURCES = {
    "pisos": ({"flat": ["pisos"], "house": ["casas"], "office": ["oficinas"], "land": ["terrenos"]},
              ["pisos", "casas", "oficinas", "terrenos"]),
    "habitaclia": ({"flat": ["pisos"], "house": ["casas"], "office": ["oficinas"], "land": ["terrenos"]}, ["pisos", "casas"]),
    "tucasa": ({}, ["viviendas"]),
    "fotocasa": ({}, ["viviendas"]),
    "yaencontre": ({"flat": ["pisos"], "house": ["casas"], "office": ["oficinas"], "land": ["terrenos"]}, ["viviendas"]),
    "milanuncios": ({"flat": ["pisos"], "house": ["casas"], "office": ["locales"], "land": ["solares"]}, ["pisos", "casas"]),
    "idealista": ({"flat": ["pisos"], "house": ["casas-chalets"], "office": ["oficinas"], "land": ["terrenos"]}, ["viviendas"]),
    "globaliza": ({"flat": ["pisos"], "house": ["casas", "chalets"], "office": ["oficinas"], "land": ["terrenos"]}, ["viviendas"]),
    "hogaria": ({"flat": ["piso"], "house": ["casa"], "office": ["oficina"], "land": ["terrenos_solares"]}, ["piso", "casa"]),
    "spainhouses": ({"flat": ["pisos"], "house": ["casas"], "office": ["oficinas"], "land": ["terrenos"]}, ["viviendas"]),
    "pisocompartido": ({}, ["habitaciones"]),
    "enalquiler": ({"flat": ["pisos-2"], "house": ["casas-7"], "office": [], "land": []}, ["pisos-2", "casas-7"]),
    "nuroa": ({"flat": ["piso"], "house": ["casa"], "office": ["oficina"], "land": ["terreno"]}, ["piso", "casa"]),
}

# Places tried without a city.
NUROA_CITIES = ["valencia", "madrid", "barcelona", "sevilla", "malaga", "bilbao", "zaragoza", "alicante"]
SPAINHOUSES_CITIES = ["valencia", "madrid", "barcelona", "malaga", "alicante", "sevilla"]
PISOS_CITIES = ["Valencia", "Madrid", "Barcelona", "Sevilla", "Malaga", "Bilbao"]
HOGARIA_PROVINCES = ["valencia", "madrid", "barcelona", "malaga", "alicante", "asturias", "cadiz", "huesca"]
SHARED_ROUTES = [
    "valencia_capital_zona_urbana", "madrid_capital_zona_urbana", "barcelona_capital", "malaga_capital_zona_urbana",
    "sevilla_capital", "bilbao",
]
# City to province, per portal.
SPAINHOUSES_PROVINCE = {
    "valencia": "valencia", "madrid": "madrid", "barcelona": "barcelona", "malaga": "malaga", "sevilla": "sevilla",
    "bilbao": "vizcaya", "ronda": "malaga", "cangas-de-onis": "asturias", "albarracin": "teruel", "cudillero": "asturias",
    "grazalema": "cadiz", "ainsa": "huesca", "ainsa-sobrarbe": "huesca", "naquera": "valencia", "requena": "valencia",
    "bunol": "valencia", "potes": "cantabria", "riano": "leon",
}
HOGARIA_CODE = {
    "madrid": 1, "barcelona": 2, "alicante": 5, "asturias": 7, "cadiz": 13, "cantabria": 14, "huesca": 25, "leon": 30,
    "malaga": 33, "sevilla": 42, "teruel": 46, "valencia": 48,
}
HOGARIA_PROVINCE = {
    "valencia": "valencia", "madrid": "madrid", "barcelona": "barcelona", "malaga": "malaga", "sevilla": "sevilla",
    "alicante": "alicante", "ronda": "malaga", "cangas-de-onis": "asturias", "albarracin": "teruel",
    "cudillero": "asturias", "grazalema": "cadiz", "ainsa": "huesca", "ainsa-sobrarbe": "huesca", "boltana": "huesca",
    "benasque": "huesca", "naquera": "valencia", "bunol": "valencia", "requena": "valencia", "potes": "cantabria",
    "riano": "leon",
}
SHARED_ROUTE_BY_CITY = {
    "valencia": "valencia_capital_zona_urbana", "madrid": "madrid_capital_zona_urbana", "barcelona": "barcelona_capital",
    "malaga": "malaga_capital_zona_urbana", "sevilla": "sevilla_capital", "zaragoza": "zaragoza_capital", "bilbao": "bilbao",
}
# slug, province, location of the rental routes; the first six are tried without a city.
RENT_ROUTES = {
    "valencia": ("valencia", 48, 50692), "madrid": ("madrid", 30, 27745), "barcelona": ("barcelona", 9, 4596),
    "sevilla": ("sevilla", 43, 46424), "malaga": ("malaga", 31, 27903), "bilbao": ("bilbao", 50, 6419),
    "zaragoza": ("zaragoza", 52, 55267), "ronda": ("ronda", 31, 41961), "cudillero": ("cudillero", 5, 16916),
    "ainsa": ("ainsa", 25, 805), "ainsa-sobrarbe": ("ainsa", 25, 805), "albarracin": ("albarracin", 46, None),
    "grazalema": ("grazalema", 13, None), "cangas-de-onis": ("cangas-de-onis", 7, None),
}
RENT_DISCOVERY = ["valencia", "madrid", "barcelona", "sevilla", "malaga", "bilbao"]
NONE = "array<string>"


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(NONE)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _each(values: Column, *templates) -> Column:
    """Paths of every template for every value, value by value."""
    return F.flatten(F.transform(values, lambda v: F.array(*[t(v) for t in templates])))


def _resources(name: str) -> Column:
    table, default = RESOURCES[name]
    types = F.col("types")
    if not table:
        return _texts(default)
    words = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _texts(v))])
    chosen = F.flatten(F.transform(types, lambda t: F.coalesce(F.try_element_at(words, t), F.array().cast(NONE))))
    return F.when(F.size(types) == 0, _texts(default)).otherwise(unique_strings(chosen))


def _pages(paths: Column, second, twice: Column) -> Column:
    return F.when(twice, _each(paths, lambda p: p, second)).otherwise(paths)


def candidate_paths(name: str) -> Column:
    """Ordered paths of one portal for a task row (``slug``, ``types``, ``rent``, ``nearby``, ``locale``)."""
    slug, rent, has_city = F.col("slug"), F.col("rent"), F.col("has_city")
    flat_slug = F.translate(slug, "-", "_")
    mode = F.when(rent, "alquiler").otherwise("venta")
    res = _resources(name)
    query_page = lambda p: _cat(p, "?page=2")
    if name == "habitaclia":
        head = F.when(rent, "/alquiler-").otherwise("/")
        city = _each(res, lambda r: _cat(head, r, "-", flat_slug, ".htm"), lambda r: _cat(head, r, "-", slug, ".htm"))
        return F.when(has_city, city).otherwise(F.array().cast(NONE))
    if name == "nuroa":
        city = F.transform(res, lambda r: _cat("/", mode, "/", r, "-", slug))
        broad = _each(res, *[lambda r, c=c: _cat("/", mode, "/", r, f"-{c}") for c in NUROA_CITIES])
        return _pages(F.when(has_city, city).otherwise(broad), query_page, has_city)
    if name == "spainhouses":
        lang = F.when(F.col("locale") == "en", "en").otherwise("es")
        root = lambda r: _cat("/", lang, "/", mode, "-", r, "-")
        province = _lookup(SPAINHOUSES_PROVINCE, slug)
        near = F.when(F.col("nearby"), province)
        city = F.array_compact(
            _each(
                res, lambda r: _cat(root(r), slug, ".html"), lambda r: _cat(root(r), slug, "-", province, ".html"),
                lambda r: _cat(root(r), near, ".html"),
            )
        )
        broad = _each(res, *[lambda r, c=c: _cat(root(r), f"{c}.html") for c in SPAINHOUSES_CITIES])
        second = lambda p: F.regexp_replace(p, r"\.html\z", "/pagina-2.html")
        return _pages(F.when(has_city, city).otherwise(broad), second, has_city)
    if name == "milanuncios":
        base = lambda r: _cat("/", mode, "-de-", r)
        plain = F.transform(res, lambda r: _cat(base(r), "/"))
        city = _each(
            res, lambda r: _cat(base(r), "-en-", slug, "/"), lambda r: _cat(base(r), "-en-", slug, "-capital/"),
            lambda r: _cat(base(r), "-en-", slug, "-", slug, "/"),
        )
        return F.when(has_city, F.concat(plain, city)).otherwise(plain)
    if name == "globaliza":
        tail = F.when(has_city, _cat("/", slug)).otherwise("")
        return F.transform(res, lambda r: _cat("/", mode, "/", r, tail))
    if name == "yaencontre":
        base = lambda r: _cat("/", mode, "/", r)
        city = _each(res, lambda r: _cat(base(r), "/", slug), lambda r: _cat(base(r), "/", slug, "-capital"))
        return F.when(has_city, city).otherwise(F.transform(res, base))
    if name == "idealista":
        base = lambda r: _cat("/", mode, "-", r, "/")
        city = _each(res, lambda r: _cat(base(r), slug, "-", slug, "/"), lambda r: _cat(base(r), slug, "/"))
        return F.when(has_city, city).otherwise(F.transform(res, base))
    if name == "fotocasa":
        where = F.when(has_city, slug).otherwise("espana")
        return F.array(_cat("/es/", F.when(rent, "alquilar").otherwise("comprar"), "/viviendas/", where, "/todas-las-zonas/l"))
    if name == "tucasa":
        base = F.when(rent, "/alquiler/viviendas/").otherwise("/compra-venta/viviendas/")
        city = F.array(_cat(base, slug, "/"), _cat(base, slug, "/", slug, "-capital/"))
        return F.when(has_city, city).otherwise(F.array(base))
    if name == "hogaria":
        code = lambda p: _lookup(HOGARIA_CODE, p).cast("string")
        own = F.when(_lookup(HOGARIA_CODE, slug).isNotNull(), slug)
        provinces = F.array_distinct(F.array_compact(F.array(_lookup(HOGARIA_PROVINCE, slug), own)))
        root = lambda r: _cat("/", mode, "-", r, "/")
        wide = lambda r, p: _cat(root(r), p, "-", code(p), "-1.aspx")
        city = F.flatten(
            F.transform(
                res,
                lambda r: F.when(
                    F.size(provinces) > 0,
                    F.flatten(F.transform(provinces, lambda p: F.array(_cat(root(r), p, "/", slug, ".aspx"), wide(r, p)))),
                ).otherwise(F.array(_cat(root(r), slug, "/", slug, ".aspx"))),
            )
        )
        broad = _each(res, *[lambda r, p=p: _cat(root(r), f"{p}-{HOGARIA_CODE[p]}-1.aspx") for p in HOGARIA_PROVINCES])
        return F.when(has_city, city).otherwise(broad)
    if name == "pisocompartido":
        route = F.coalesce(_lookup(SHARED_ROUTE_BY_CITY, flat_slug), flat_slug)
        tails = ["", "_capital_zona_urbana", "_capital", "_zona_urbana"]
        routes = F.when(has_city, F.array(*[_cat(route, t) for t in tails])).otherwise(_texts(SHARED_ROUTES))
        paths = F.transform(routes, lambda r: _cat("/alquiler-habitaciones-", r, "/"))
        return _pages(paths, query_page, has_city)
    if name == "enalquiler":
        # resource words carry the category code: "<segment>-<code>"
        def route(r: Column, where: Column, province: Column, location: Column) -> Column:
            parts = F.split(r, "-")
            tail = F.coalesce(_cat("-", location), F.lit(""))
            return _cat("/alquiler-", parts[0], "-", where, "-", province, "-", parts[1], "-0", tail, ".html")

        province, location = F.col("rent_province"), F.col("rent_location")
        bare = F.when(F.col("nearby") | location.isNull(), F.lit(True))
        city = F.array_compact(
            _each(
                res, lambda r: route(r, F.col("rent_slug"), province, location),
                lambda r: F.when(bare, route(r, F.col("rent_slug"), province, F.lit(None).cast("string"))),
            )
        )
        def seeded(name: str) -> Column:
            where, code, place = RENT_ROUTES[name]
            return F.transform(res, lambda r: route(r, F.lit(where), F.lit(str(code)), F.lit(str(place))))

        broad = F.flatten(F.array(*[seeded(c) for c in RENT_DISCOVERY]))
        return _pages(F.when(has_city & province.isNotNull(), city).otherwise(broad), query_page, has_city)
    if name == "pisos":
        slugs = F.when(has_city, F.array(flat_slug)).otherwise(_texts([c.lower() for c in PISOS_CITIES]))
        all_slugs = _each(slugs, lambda s: _cat(s, "_capital_zona_urbana"), lambda s: _cat(s, "_capital"), lambda s: s)
        paths = F.flatten(F.transform(all_slugs, lambda s: F.transform(res, lambda r: _cat("/", mode, "/", r, "-", s, "/"))))
        return F.filter(paths, allowed_path)
    raise ValueError(f"unknown portal {name}")


def crawl_plan(tasks: DataFrame, routes: DataFrame | None = None, key: str = "search_id") -> DataFrame:
    """Pages to fetch per task: ``page_no`` counts from 1 within the portal's request cap.

    ``routes`` (``city_key``, ``province``, ``location``) overrides the built-in rental
    routes, as ``best_suggestions`` gives them. Rent-only portals plan nothing for other
    requests.
    """
    city = F.coalesce(F.col("q.city"), F.lit(""))
    base = tasks.select(
        key, "loc_pos", "location", "src_pos", "portal",
        slugify(city).alias("slug"), normalize_text(city).alias("city_key"), (city != "").alias("has_city"),
        F.col("q.property_types").alias("types"), F.coalesce(F.col("q.transaction_type") == "rent", F.lit(False)).alias("rent"),
        F.col("q.transaction_type").alias("transaction"), F.col("q.nearby_towns").alias("nearby"), F.col("q.locale").alias("locale"),
    )
    known = lambda i: _lookup({k: str(v[i]) for k, v in RENT_ROUTES.items() if v[i] is not None}, F.col("slug"))
    if routes is not None:
        found = routes.select("city_key", F.col("province").cast("bigint").cast("string").alias("_p"), F.col("location").cast("bigint").cast("string").alias("_l"))
        base = base.join(found, "city_key", "left")
    else:
        base = base.withColumns({"_p": F.lit(None).cast("string"), "_l": F.lit(None).cast("string")})
    base = base.withColumns(
        {
            "rent_slug": F.when(F.col("_p").isNotNull(), F.col("slug")).otherwise(known(0)),
            "rent_province": F.coalesce("_p", known(1)),
            "rent_location": F.when(F.col("_p").isNotNull(), F.col("_l")).otherwise(known(2)),
        }
    )
    paths = None
    for name in rules.PORTALS:
        capped = F.slice(unique_strings(candidate_paths(name)), 1, POLICIES[name].max_requests)
        paths = F.when(F.col("portal") == name, capped) if paths is None else paths.when(F.col("portal") == name, capped)
    homes = (F.size("types") == 0) | F.arrays_overlap("types", _texts(["flat", "house"]))
    served = ~F.col("portal").isin(rules.RENT_ONLY_SOURCES) | (
        F.coalesce(F.col("transaction") == "rent", F.lit(True)) & homes
    )
    sluggable = ~F.col("has_city") | (F.col("slug") != "")
    return (
        base.filter(served & sluggable)
        .select(key, "loc_pos", "location", "src_pos", "portal", F.posexplode_outer(paths).alias("pos", "path"))
        .filter("path IS NOT NULL")
        .select(key, "loc_pos", "location", "src_pos", "portal", (F.col("pos") + 1).alias("page_no"), "path")
    )


def index_links(index_pages: DataFrame, cities: DataFrame) -> DataFrame:
    """Links of stored index pages that lead to a city.

    ``index_pages``: ``operation_path``, ``html``; ``cities``: ``city_slug``. A link counts
    when its path runs under the operation path and one segment is the city's slug or
    starts with it and a hyphen. Every hyphen-bounded head of a segment becomes a join
    key, so the match is an equi-join.
    """
    base = rules.PORTAL_URLS["tucasa"]
    links = (
        index_pages.select(
            "operation_path", F.posexplode_outer(all_matches(F.col("html"), r"""(?i)<a[^>]+href=["']([^"']+)["'][^>]*>""")).alias("pos", "href")
        )
        .filter("href IS NOT NULL")
        .withColumn("url", full_url(F.col("href"), base))
        .filter(F.contains(page_path(F.col("url")), F.concat(F.lit("/"), F.col("operation_path"), F.lit("/"))))
    )
    parts = F.filter(F.transform(F.split(page_path(F.col("url")), "/"), lambda s: slugify(s)), lambda s: s != "")

    def heads(segment: Column) -> Column:
        words = F.split(segment, "-")
        return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), "-"))

    keyed = links.select(
        "operation_path", "pos", "url", F.explode_outer(F.array_distinct(F.flatten(F.transform(parts, heads)))).alias("city_slug")
    )
    hits = keyed.join(cities.select("city_slug").distinct(), "city_slug")
    return hits.groupBy("operation_path", "city_slug", F.lower("url").alias("_key")).agg(
        F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos")
    ).drop("_key")


def read_suggestion_rows(raw: DataFrame) -> DataFrame:
    """Place suggestions from stored responses (``city``, ``payload``); typographic quotes repaired."""
    repaired = F.translate("payload", "\u00a0\u2018\u2019\u201c\u201d", " ''\"\"")
    items = F.from_json(
        repaired,
        "suggestions array<struct<type:string,name:string,province:string,location:string,quantity:string>>",
        {"allowSingleQuotes": "false"},
    )["suggestions"]
    num = lambda n: parse_number(F.col(f"s.{n}"))
    return (
        raw.select("city", F.posexplode_outer(items).alias("pos", "s"))
        .filter("s IS NOT NULL")
        .select("city", "pos", F.col("s.type").alias("type"), F.col("s.name").alias("name"),
                num("province").alias("province"), num("location").alias("location"), num("quantity").alias("quantity"))
    )


def best_suggestions(suggestions: DataFrame) -> DataFrame:
    """Best suggestion per city by additive score, then quantity, then order; map-side combined."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    name, city = F.coalesce("name", F.lit("")), F.col("city")
    name_norm, city_norm = normalize_text(name), normalize_text(city)
    quantity = F.coalesce("quantity", F.lit(0.0))
    named = (
        F.when(city_norm == "", 0)
        .when(name_norm == city_norm, 100)
        .when(F.startswith(name_norm, city_norm), 70)
        .when(F.contains(name_norm, city_norm), 40)
        .otherwise(0)
    )
    score = (
        F.when(kind == "city", 200).when(kind == "province", 120).when(kind == "district", 40).otherwise(0)
        + named
        + F.when((slugify(city) != "") & (slugify(name) == slugify(city)), 60).otherwise(0)
        + F.when(quantity != 0, F.least(F.lit(40), F.floor(quantity / 20))).otherwise(0)
    )
    ranked = suggestions.withColumn("score", score)
    best = F.max_by(
        F.struct("name", "province", "location", "score"), F.struct(F.col("score"), quantity, -F.col("pos"))
    )
    # a best suggestion without a province resolves nothing; a zero location counts as none
    return (
        ranked.groupBy("city").agg(best.alias("b"))
        .select(
            "city", normalize_text(F.col("city")).alias("city_key"), "b.name", "b.province",
            F.nullif("b.location", F.lit(0.0)).alias("location"), "b.score",
        )
        .filter("province IS NOT NULL")
    )


