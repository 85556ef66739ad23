"""Listing order and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost import rules
from roost.operators import filters as flt
from roost.operators.score import PREPARED, prepare_listings, with_score

NO_PRICE = float(2**53 - 1)


def listing_order() -> list[Column]:
    """Score, cheapest, most rooms, newest, then id in locale order."""
    return [
        F.col("score").desc(),
        F.coalesce(F.col("price_eur"), F.lit(NO_PRICE)).asc(),
        F.coalesce(F.col("rooms"), F.lit(-1.0)).desc(),
        F.col("last_seen_at").desc_nulls_last(),
        F.collate(F.col("canonical_id"), "UNICODE").asc(),
    ]


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: Column, bound: int, rank: str) -> DataFrame:
    """First ``limit`` rows per group; ``bound`` is a literal upper bound of ``limit``.

    The literal filter lets Spark cut every group to ``bound`` rows before the shuffle,
    so a hot group sends at most ``bound`` rows per task. The exact cut follows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= bound).filter(F.col(rank) <= limit)


_DEFAULTS = {
    "locale": "en", "property_types": [], "nearby_towns": False, "strict_constraints": True,
    "renovation_ok": False, "tags": [],
}
CRITERIA_TYPES = {
    "locale": "string", "transaction_type": "string", "property_types": "array<string>", "city": "string",
    "location_hints": "array<string>", "nearby_towns": "boolean", "min_rooms": "int", "min_capacity_people": "int",
    "max_price_eur": "bigint", "min_floor": "int", "exclude_ground_floor": "boolean", "prefer_exterior": "boolean",
    "strict_constraints": "boolean", "renovation_ok": "boolean", "tags": "array<string>",
}


def criteria_struct(criteria: dict) -> Column:
    """One search's criteria as a struct of literals, so bounds reach the scan."""
    from roost.functions.text import normalize_text, slugify

    values = {**_DEFAULTS, **criteria}
    unknown = set(values) - set(CRITERIA_TYPES)
    if unknown:
        raise ValueError(f"unknown criteria: {sorted(unknown)}")

    def literal(name: str, kind: str) -> Column:
        value = values.get(name)
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(value).cast(kind)

    fields = {name: literal(name, kind) for name, kind in CRITERIA_TYPES.items()}
    city = F.coalesce(fields["city"], F.lit(""))
    fields["city_norm"] = normalize_text(city)
    fields["city_slug"] = slugify(city, "_")
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def rank_listings(listings: DataFrame, criteria: dict, limit: int | None = None) -> DataFrame:
    """Filter, score and order listings for one search.

    With ``limit`` Spark keeps a bounded heap per task; without it the result is range-sorted.
    """
    wanted = {t.lower() for t in criteria.get("tags", [])}
    signals = bool(
        wanted & set(rules.LIGHT_TAGS) or criteria.get("prefer_exterior") or criteria.get("renovation_ok")
    )
    prepared = prepare_listings(listings, text_signals=signals, hints=bool(criteria.get("location_hints")))
    kept = prepared.withColumn("q", criteria_struct(criteria)).filter(flt.base_ok() & flt.floor_ok())
    ranked = with_score(kept).orderBy(*listing_order())
    if limit is not None:
        ranked = ranked.limit(limit)
    return ranked.drop("q", *PREPARED)
