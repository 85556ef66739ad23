"""Published rows, cards, card texts and map coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost import rules
from roost.functions.numbers import floor_label, format_price, valid_coordinate
from roost.functions.text import fold_accents, safe_public_text
from roost.functions.urls import domain_of, safe_https_url
from roost.operators.portals.common import number_text

MAX_CARDS = 20


def public_listings(results: DataFrame) -> DataFrame:
    """Rows with a safe https link only; texts cleaned and cut to their published lengths.

    Raw fields are dropped, but floor label and coordinates are kept as columns so that
    cards can show them.
    """
    safe = F.filter(F.transform("image_urls", safe_https_url), lambda u: u.isNotNull())
    blank_to_null = lambda name, n: F.when(F.col(name) != "", safe_public_text(F.col(name), n))
    return (
        results.withColumn("url", safe_https_url(F.col("url")))
        .filter("url IS NOT NULL")
        .withColumns(
            {
                "title": safe_public_text(F.col("title"), 300),
                "city": safe_public_text(F.col("city"), rules.MAX_TEXT_LENGTH),
                "image_urls": F.slice(safe, 1, 12),
                "why_matched": F.slice(F.transform("why_matched", lambda r: safe_public_text(r, 300)), 1, 10),
                "description": blank_to_null("description", 2_000),
                "tags": F.slice(F.transform("tags", lambda t: safe_public_text(t, 100)), 1, rules.MAX_TAGS),
                "floor_label": floor_label(F.coalesce("chars", F.array().cast("array<string>"))),
                "lat": F.when(valid_coordinate(F.col("lat"), F.col("lon")), F.col("lat")),
                "lon": F.when(valid_coordinate(F.col("lat"), F.col("lon")), F.col("lon")),
            }
        )
        .drop("raw", "chars", "price_raw", "source_path")
    )


def present_cards(public: DataFrame, faithful: bool = False) -> DataFrame:
    """First 20 published rows of every search as cards.

    ``faithful`` leaves floor and coordinates out, as a service does that drops them
    before it builds its cards.
    """
    rank = F.row_number().over(Window.partitionBy("search_id").orderBy("result_rank"))
    rooms = F.concat(number_text(F.col("rooms")), F.when(F.col("locale") == "es", " hab.").otherwise(" rooms"))
    shown = F.lit(None).cast("string") if faithful else F.col("floor_label")
    place = lambda name: F.lit(None).cast("double") if faithful else F.col(name)
    return (
        public.withColumn("card_pos", rank)
        .filter(F.col("card_pos") <= MAX_CARDS)
        .select(
            "search_id",
            "card_pos",
            "locale",
            "location",
            "canonical_id",
            "portal",
            domain_of(F.col("url")).alias("source_domain"),
            "title",
            "city",
            "url",
            F.get("image_urls", F.lit(0)).alias("image_url"),
            format_price(F.col("price_eur"), F.col("locale")).alias("price"),
            F.array_compact(F.array(rooms, shown, F.col("property_type"))).alias("facts"),
            "score",
            F.slice("why_matched", 1, 3).alias("why_matched"),
            place("lat").alias("latitude"),
            place("lon").alias("longitude"),
        )
    )


def cards_markdown(cards: DataFrame, searches: DataFrame) -> DataFrame:
    """One text per search in its language. ``searches``: ``search_id``, ``locale``.

    A search has at most 20 cards, so gathering them is bounded.
    """
    nl, dot = F.lit("\n"), F.lit(" · ")
    line = F.concat_ws(
        "\n",
        F.concat(F.col("card_pos").cast("string"), F.lit(". **["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")**")),
        F.concat(
            F.col("price"), dot, F.col("city"),
            F.when(F.size("facts") > 0, F.concat(dot, F.array_join("facts", " · "))).otherwise(""),
            F.lit(" · score "), F.col("score").cast("string"), F.lit("/100"),
        ),
        F.when(F.col("image_url").isNotNull(), F.concat(F.lit("!["), F.col("title"), F.lit("]("), F.col("image_url"), F.lit(")"))),
        F.when(
            F.size("why_matched") > 0,
            F.concat(
                F.when(F.col("locale") == "es", "Por qué encaja: ").otherwise("Why matched: "), F.array_join("why_matched", "; ")
            ),
        ),
        F.lit(""),
    )
    texts = cards.select("search_id", "card_pos", line.alias("line")).groupBy("search_id").agg(
        F.sort_array(F.collect_list(F.struct("card_pos", "line"))).alias("lines")
    )
    es = F.col("locale") == "es"
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    head = F.when(es, "### Vista rápida (tarjetas)").otherwise("### Quick property cards")
    none = F.when(es, "No se encontraron propiedades para generar tarjetas.").otherwise("No properties found to build cards.")
    return searches.select("search_id", "locale").join(texts, "search_id", "left").select(
        "search_id", F.when(F.col("lines").isNull(), none).otherwise(F.concat(head, nl, body)).alias("markdown")
    )


# -- map ------------------------------------------------------------------------------

def text_hash(c: Column) -> Column:
    """31-multiplier hash of the text, modulo 2^32."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(
        chars, F.lit(0).cast("bigint"), lambda h, x: (h * 31 + F.ascii(x)) % F.lit(2**32).cast("bigint")
    )


def _label(c: Column) -> Column:
    """City text as the map compares it: hyphens stay."""
    kept = F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def known_city(c: Column) -> Column:
    """Longest known city name inside the text; null when there is none."""
    out = None
    for key in sorted(rules.CITY_CENTRES, key=len, reverse=True):
        hit = F.contains(c, F.lit(key))
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def _centre(key: Column, axis: int) -> Column:
    out = None
    for name, point in rules.CITY_CENTRES.items():
        hit = key == name
        out = F.when(hit, F.lit(point[axis])) if out is None else out.when(hit, F.lit(point[axis]))
    return out


def map_points(cards: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A point per card: its own coordinates, else a jittered point near a known centre.

    ``labels``: ``search_id``, ``labels`` (array of place texts of the request), tried in
    order when the card's own city is unknown. The last resort is one shared anchor.
    """
    if labels is not None:
        cards = cards.join(labels, "search_id", "left")
    else:
        cards = cards.withColumn("labels", F.array().cast("array<string>"))
    from_request = F.get(
        F.filter(F.transform("labels", lambda x: known_city(_label(x))), lambda k: k.isNotNull()), F.lit(0)
    )
    keyed = cards.withColumns(
        {
            "city_key": F.coalesce(known_city(_label(F.col("city"))), from_request),
            "h": text_hash(F.col("canonical_id")),
            "anchor": text_hash(F.lit("spain")),
        }
    )
    h, anchor, key = F.col("h"), F.col("anchor"), F.col("city_key")
    base_lat = F.coalesce(_centre(key, 0), F.lit(36.0) + ((anchor % 7000) / F.lit(7000.0)) * F.lit(7.7))
    base_lon = F.coalesce(
        _centre(key, 1), F.lit(-9.2) + ((F.floor(anchor / 7000) % 11000) / F.lit(11000.0)) * F.lit(12.0)
    )
    jitter_lat = (((h % 200) - 100) / F.lit(100.0)) * F.lit(0.012)
    jitter_lon = (((F.floor(h / 200) % 200) - 100) / F.lit(100.0)) * F.lit(0.014)
    exact = valid_coordinate(F.col("latitude"), F.col("longitude"))
    return keyed.select(
        "search_id",
        "canonical_id",
        exact.alias("exact"),
        F.when(exact, F.col("latitude")).otherwise(base_lat + jitter_lat).alias("lat"),
        F.when(exact, F.col("longitude")).otherwise(base_lon + jitter_lon).alias("lon"),
    )


def map_bounds(points: DataFrame) -> DataFrame:
    """Box around the points of every search."""
    return points.groupBy("search_id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.count("*").alias("n_points"),
    )
