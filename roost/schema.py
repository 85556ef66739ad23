"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B, _I = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
_A = T.ArrayType(T.StringType())


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Canonical listing row. `crawl_location` is the normalised place a page was fetched for.
LISTING = _struct(
    ("canonical_id", _S), ("portal", _S), ("portal_listing_id", _S), ("url", _S), ("title", _S), ("city", _S),
    ("price_eur", _D), ("rooms", _D), ("property_type", _S), ("image_urls", _A), ("last_seen_at", T.TimestampType()),
    ("description", _S), ("tags", _A), ("capacity_people", _D), ("source_path", _S), ("chars", _A),
    ("price_raw", _S), ("bathrooms", _D), ("area_m2", _D), ("lat", _D), ("lon", _D), ("raw", _S),
    ("crawl_location", _S), ("seq", T.LongType()),
)

# One saved search per row; everything but the id is optional.
SEARCH = _struct(
    ("search_id", _S), ("query_text", _S), ("locale", _S), ("transaction_type", _S), ("property_types", _A),
    ("city", _S), ("locations", _A), ("location_hints", _A), ("nearby_towns", _B), ("min_rooms", _I),
    ("min_capacity_people", _I), ("max_price_eur", T.LongType()), ("min_floor", _I), ("exclude_ground_floor", _B),
    ("prefer_exterior", _B), ("strict_constraints", _B), ("renovation_ok", _B), ("tags", _A), ("sources", _A),
    ("per_location_limit", _I), ("max_results_total", _I),
)

# Outcome of reading one portal for one place.
OUTCOME = _struct(
    ("portal", _S), ("location_key", _S), ("source_kind", _S), ("warnings", _A), ("error_code", _S), ("error_message", _S),
)

# Stored portal pages.
PAGE = _struct(
    ("portal", _S), ("crawl_location", _S), ("path", _S), ("page_no", _I), ("http_status", _I), ("html", _S),
    ("fetched_at", T.TimestampType()), ("headers", T.MapType(_S, _S)),
)

SUGGESTION = _struct(
    ("type", _S), ("name", _S), ("province", _S), ("location", _S), ("quantity", T.LongType()),
)
