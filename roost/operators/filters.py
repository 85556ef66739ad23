"""Hard constraints of a search, as predicates over one candidate row.

A candidate row holds the prepared listing columns (see ``score.prepare_listings``)
and a struct ``q`` with the criteria of its search. Every predicate yields true or
false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roost.functions.text import contains_term


def _q(name: str) -> Column:
    return F.col(f"q.{name}")


def strict() -> Column:
    return F.coalesce(_q("strict_constraints"), F.lit(True))


def _bounded(bound: Column, value: Column, holds: Column) -> Column:
    """A bound that an unknown value passes only in lenient mode."""
    return F.when(bound.isNull(), True).when(value.isNull(), ~strict()).otherwise(holds)


def price_ok() -> Column:
    return _bounded(_q("max_price_eur"), F.col("price_eur"), F.col("price_eur") <= _q("max_price_eur"))


def rooms_ok() -> Column:
    return _bounded(_q("min_rooms"), F.col("rooms"), F.col("rooms") >= _q("min_rooms"))


def capacity_ok() -> Column:
    """An unknown capacity fails even in lenient mode."""
    return _q("min_capacity_people").isNull() | F.coalesce(
        F.col("capacity_people") >= _q("min_capacity_people"), F.lit(False)
    )


def type_ok() -> Column:
    wanted = _q("property_types")
    return (
        F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, True)
        .when(F.col("property_type").isNull(), ~strict())
        .otherwise(F.array_contains(wanted, F.col("property_type")))
    )


def city_match() -> Column:
    """City text equals or contains the search city as whole words.

    Only when the listing has no city text does its source path decide.
    """
    by_text = contains_term(F.col("city_norm"), _q("city_norm"))
    by_path = (_q("city_slug") != "") & F.contains(
        F.col("path_lower"), F.concat(_q("city_slug"), F.lit("_capital"))
    )
    return F.coalesce(
        (_q("city_norm") != "") & F.when(F.col("city_norm") != "", by_text).otherwise(by_path), F.lit(False)
    )


def has_city() -> Column:
    return F.coalesce(_q("city") != "", F.lit(False))


def nearby() -> Column:
    return F.coalesce(_q("nearby_towns"), F.lit(False))


def city_ok() -> Column:
    return ~has_city() | nearby() | city_match()


def floor_ok() -> Column:
    ground = F.coalesce(_q("exclude_ground_floor") & (F.col("floor_no") == 0), F.lit(False))
    return ~ground & _bounded(_q("min_floor"), F.col("floor_no"), F.col("floor_no") >= _q("min_floor"))


def has_floor_filters() -> Column:
    return _q("min_floor").isNotNull() | F.coalesce(_q("exclude_ground_floor"), F.lit(False))


def base_ok() -> Column:
    """All hard constraints but the floor ones."""
    return price_ok() & rooms_ok() & capacity_ok() & type_ok() & city_ok()
