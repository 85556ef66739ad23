"""From saved searches to a table of (search, place, portal) work.

Everything here is row-local: the arrays of a request are bounded by its schema, so
places and portals are planned with array functions and exploded once. No shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roost import rules, schema
from roost.functions.text import WS, normalize_text, slugify, trim_ws, unique_strings

_NONE = "array<string>"


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(_NONE)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def conform(searches: DataFrame) -> DataFrame:
    """Search columns in schema order and type; absent optional columns become null."""
    have = set(searches.columns)
    return searches.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.SEARCH.fields
        ]
    )


def request_errors(searches: DataFrame) -> DataFrame:
    """Add ``errors``: the names of fields outside their bounds."""
    text_ok = lambda x: F.length(x).between(1, rules.MAX_TEXT_LENGTH)

    def bad_number(name: str, low: int, high: int) -> tuple[str, Column]:
        return name, ~F.col(name).between(low, high)

    def bad_list(name: str, size: int, ok=text_ok) -> tuple[str, Column]:
        return name, (F.size(name) > size) | F.exists(F.col(name), lambda x: x.isNull() | ~ok(x))

    checks = [
        ("search_id", F.col("search_id").isNull()),
        ("query_text", F.length("query_text") > rules.MAX_QUERY_LENGTH),
        ("locale", ~F.col("locale").isin("es", "en")),
        ("transaction_type", ~F.col("transaction_type").isin("buy", "rent")),
        ("city", ~text_ok(F.col("city"))),
        bad_list("property_types", len(rules.PROPERTY_TYPES), lambda x: x.isin(rules.PROPERTY_TYPES)),
        bad_list("locations", rules.MAX_LOCATIONS),
        bad_list("location_hints", rules.MAX_HINTS),
        bad_list("tags", rules.MAX_TAGS),
        bad_list("sources", rules.MAX_SOURCES, lambda x: x.isin(rules.PORTALS)),
        bad_number("min_rooms", 0, 100),
        bad_number("min_capacity_people", 0, 10_000),
        bad_number("max_price_eur", 0, 1_000_000_000),
        bad_number("min_floor", 0, 300),
        bad_number("per_location_limit", 1, rules.MAX_PER_LOCATION),
        bad_number("max_results_total", 1, rules.MAX_RESULTS),
    ]
    flags = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]
    return searches.withColumn("errors", F.array_compact(F.array(*flags)))


def split_requests(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with their ``errors``."""
    checked = request_errors(conform(searches))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def default_sources() -> Column:
    """Portals for a request that names none."""
    types = _or_empty(F.col("property_types"))
    homes = (F.size(types) == 0) | F.arrays_overlap(types, _texts("flat", "house"))
    rentable = F.coalesce(F.col("transaction_type") == "rent", F.lit(True)) & homes
    return F.when(rentable, _texts(*rules.DEFAULT_SOURCES, *rules.RENT_ONLY_SOURCES)).otherwise(
        _texts(*rules.DEFAULT_SOURCES)
    )


def requested_places() -> Column:
    return (
        F.when(F.size(_or_empty(F.col("locations"))) > 0, unique_strings(F.col("locations")))
        .when(F.coalesce(F.col("city") != "", F.lit(False)), unique_strings(F.array("city")))
        .otherwise(F.array().cast(_NONE))
    )


def _segments(place: Column) -> Column:
    parts = F.transform(F.split(place, rf"{WS}[-–—]{WS}"), trim_ws)
    return F.filter(parts, lambda s: F.length(s) > 0)


def _either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _search_place(place: Column, city: Column) -> Column:
    """Municipality to search for a place text such as ``City - District``."""
    parts = _segments(place)
    city_norm = normalize_text(city)
    names_city = (F.coalesce(city, F.lit("")) != "") & F.exists(
        parts, lambda s: _either_contains(normalize_text(s), city_norm)
    )
    return F.when(F.size(parts) < 2, place).when(names_city, city).otherwise(F.get(parts, F.lit(0)))


def _place_hints(place: Column, search: Column) -> Column:
    """Segments of the place text that are not the searched municipality."""
    parts = _segments(place)
    target = normalize_text(search)
    rest = F.filter(
        parts, lambda s: (normalize_text(s) != "") & ~_either_contains(normalize_text(s), target)
    )
    return F.when(F.size(parts) < 2, F.array().cast(_NONE)).otherwise(unique_strings(rest))


def plan_requests(searches: DataFrame, max_tasks: int = rules.MAX_SEARCH_TASKS) -> DataFrame:
    """One row per request: criteria, places, portals after the fan-out cap, warnings, status.

    ``status`` is ``run``, ``no_sources`` or ``missing_locations``.
    """
    req = conform(searches).withColumns(
        {
            "requested": requested_places(),
            "explicit": F.coalesce(F.size("sources") > 0, F.lit(False)),
            "allowed": unique_strings(F.coalesce(F.col("sources"), default_sources())),
            "cap_place": F.coalesce("per_location_limit", F.lit(rules.DEFAULT_PER_LOCATION)),
            "cap_total": F.coalesce("max_results_total", F.lit(rules.DEFAULT_RESULTS)),
            "is_strict": F.coalesce("strict_constraints", F.lit(True)),
        }
    )
    req = req.withColumn(
        "status",
        F.when(F.size("allowed") == 0, "no_sources")
        .when((F.size("requested") == 0) & F.col("is_strict"), "missing_locations")
        .otherwise("run"),
    )
    # 1. every requested text with the place to search and its leftover hints
    places = F.when(F.size("requested") == 0, _texts(rules.DISCOVERY)).otherwise(F.col("requested"))
    found = F.transform(places, lambda p: F.struct(p.alias("requested"), _search_place(p, F.col("city")).alias("search")))
    req = req.withColumn("found", found)
    keyed = F.transform(
        "found",
        lambda x: F.struct(
            x["requested"].alias("requested"),
            x["search"].alias("search"),
            normalize_text(x["search"]).alias("key"),
            _place_hints(x["requested"], x["search"]).alias("hints"),
        ),
    )
    req = req.withColumn("found", keyed)
    # 2. texts with the same search key become one place; first spelling and order win
    keys = F.array_distinct(F.transform("found", lambda x: x["key"]))

    def merged(key: Column, i: Column) -> Column:
        group = F.filter("found", lambda x: x["key"] == key)
        return F.struct(
            i.alias("loc_pos"),
            F.get(group, F.lit(0))["search"].alias("location"),
            key.alias("location_key"),
            F.transform(group, lambda x: x["requested"]).alias("requested"),
            unique_strings(F.flatten(F.transform(group, lambda x: x["hints"]))).alias("hints"),
        )

    req = req.withColumn("places", F.transform(keys, merged)).withColumn("n_places", F.size("places"))
    # 3. fan-out cap, only for portals chosen by default
    over = ~F.col("explicit") & (F.col("n_places") * F.size("allowed") > max_tasks)
    capped = F.greatest(F.lit(1), F.floor(F.lit(max_tasks) / F.col("n_places"))).cast("int")
    portals = F.when(over, F.slice("allowed", 1, capped)).otherwise(F.col("allowed"))
    n_all = F.size("allowed").cast("string")
    explicit_note = F.concat(
        F.lit("Explicit sources were provided ("),
        n_all,
        F.lit("). Coverage is restricted to selected portals; omit sources for default broad aggregation."),
    )
    place_notes = F.transform(
        F.filter("found", lambda x: x["search"] != x["requested"]),
        lambda x: F.concat(
            F.lit("Normalized location '"),
            x["requested"],
            F.lit("' to '"),
            x["search"],
            F.lit("' for portal compatibility (district-level matching is applied during rerank)."),
        ),
    )
    fanout_note = F.concat(
        F.lit("High fanout detected ("),
        F.col("n_places").cast("string"),
        F.lit(" search locations x "),
        n_all,
        F.lit(" sources). Auto-capped to "),
        F.size(portals).cast("string"),
        F.lit(" sources to meet runtime budget."),
    )
    notes = F.concat(
        F.when(F.col("explicit"), F.array(explicit_note)).otherwise(F.array().cast(_NONE)),
        place_notes,
        F.when(over, F.array(fanout_note)).otherwise(F.array().cast(_NONE)),
    )
    fixed_notes = F.when(F.col("status") == "missing_locations", _texts(rules.CONTEXT_ONLY_WARNING)).otherwise(
        F.array().cast(_NONE)
    )
    return req.withColumns(
        {
            "portals": portals,
            "request_warnings": F.when(F.col("status") == "run", unique_strings(notes)).otherwise(fixed_notes),
            "base_q": _base_criteria(),
        }
    ).select(
        "search_id", "status", "requested", "places", "n_places", "portals", "cap_place", "cap_total", "is_strict",
        "request_warnings", "base_q",
    )


def _base_criteria() -> Column:
    """Criteria with defaults, without a place."""
    return F.struct(
        F.coalesce("locale", F.lit("en")).alias("locale"),
        F.col("transaction_type"),
        _or_empty(F.col("property_types")).alias("property_types"),
        unique_strings(_or_empty(F.col("location_hints"))).alias("location_hints"),
        F.coalesce("nearby_towns", F.lit(False)).alias("nearby_towns"),
        F.col("min_rooms"),
        F.col("min_capacity_people"),
        F.col("max_price_eur"),
        F.col("min_floor"),
        F.col("exclude_ground_floor"),
        F.col("prefer_exterior"),
        F.col("is_strict").alias("strict_constraints"),
        F.coalesce("renovation_ok", F.lit(False)).alias("renovation_ok"),
        unique_strings(_or_empty(F.col("tags"))).alias("tags"),
    )


BASE_FIELDS = [
    "locale", "transaction_type", "property_types", "location_hints", "nearby_towns", "min_rooms",
    "min_capacity_people", "max_price_eur", "min_floor", "exclude_ground_floor", "prefer_exterior",
    "strict_constraints", "renovation_ok", "tags",
]


def criteria_for(place: Column | None, hints: Column, base: str = "base_q") -> Column:
    """Base criteria plus the hints and the city of one place (null for none)."""
    fields = [F.col(f"{base}.{n}").alias(n) for n in BASE_FIELDS if n != "location_hints"]
    city = place if place is not None else F.lit(None).cast("string")
    return F.struct(
        *fields,
        unique_strings(F.concat(F.col(f"{base}.location_hints"), hints)).alias("location_hints"),
        city.alias("city"),
        normalize_text(F.coalesce(city, F.lit(""))).alias("city_norm"),
        slugify(F.coalesce(city, F.lit("")), "_").alias("city_slug"),
    )


def plan_tasks(requests: DataFrame, key: str = "search_id") -> DataFrame:
    """One row per (request, place, portal) to run, with the criteria of that place."""
    exploded = (
        requests.filter("status = 'run'")
        .select(key, "n_places", "cap_place", "cap_total", "base_q", "portals", F.explode("places").alias("p"))
        .select(
            key, "n_places", "cap_place", "cap_total", "base_q", "p.*",
            F.posexplode("portals").alias("src_pos", "portal"),
        )
    )
    discovery = F.col("location") == rules.DISCOVERY
    return exploded.select(
        key,
        "n_places",
        "cap_total",
        "loc_pos",
        "location",
        F.when(discovery, F.lit(rules.DISCOVERY)).otherwise(F.col("location_key")).alias("location_key"),
        "src_pos",
        "portal",
        discovery.alias("discovery"),
        F.when(discovery, F.col("cap_total")).otherwise(F.col("cap_place")).alias("cap"),
        criteria_for(F.when(~discovery, F.col("location")), F.col("hints")).alias("q"),
    )


def rent_only_support(portal: Column, transaction: Column, types: Column) -> Column:
    """Whether a portal serves the request: two portals list rentals of homes only."""
    homes = (F.size(types) == 0) | F.arrays_overlap(types, _texts("flat", "house"))
    return ~portal.isin(rules.RENT_ONLY_SOURCES) | (F.coalesce(transaction == "rent", F.lit(True)) & homes)


def empty_like(spark, struct: T.StructType) -> DataFrame:
    return spark.createDataFrame([], struct)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
