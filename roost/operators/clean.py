"""Cleaning of any raw listing table: text, numbers, type, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roost.functions.numbers import extract_floor, parse_price, parse_rooms
from roost.functions.text import normalize_text, strip_tags, unique_strings
from roost.functions.urls import domain_of, listing_url_key, safe_https_url
from roost.operators.portals.common import area_in, bathrooms_in, infer_tags, infer_type


def clean_listings(raw: DataFrame) -> DataFrame:
    """Add cleaned columns to raw rows with ``title``, ``description``, ``price_raw``, ``url``, ``chars``.

    One projection over the table. A price that held a decimal part is flagged: its digits
    are read as one number.
    """
    staged = raw.withColumns(
        {
            "title": strip_tags(F.coalesce("title", F.lit(""))),
            "description": strip_tags(F.coalesce("description", F.lit(""))),
            "chars": unique_strings(F.coalesce("chars", F.array().cast("array<string>"))),
        }
    )
    text = F.concat(F.col("title"), F.lit(" "), F.col("description"))
    facts = F.concat_ws(" ", F.array_join("chars", " "), text)
    return staged.withColumns(
        {
            "title_norm": normalize_text(F.col("title")),
            "price_eur": parse_price(F.col("price_raw")),
            "price_suspect": F.coalesce(F.col("price_raw").rlike(r"[,.][0-9]{1,2}(?![0-9])"), F.lit(False)),
            "rooms": parse_rooms(facts),
            "bathrooms": bathrooms_in(facts),
            "area_m2": area_in(facts),
            "floor_no": extract_floor(F.col("chars")),
            "property_type": infer_type(text),
            "tags": infer_tags(text),
            "url_key": listing_url_key(F.coalesce("url", F.lit(""))),
            "safe_url": safe_https_url(F.col("url")),
            "domain": domain_of(F.coalesce("url", F.lit(""))),
        }
    )
