"""Duplicate collapse inside the candidate list of each search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost.functions.numbers import round_half_up
from roost.functions.text import normalize_text, overlap_at_least, title_tokens
from roost.functions.urls import listing_url_key
from roost.operators.rank import listing_order

MIN_OVERLAP = 0.9
PRICE_FLOOR = 5000
PRICE_SHARE = 0.05


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(window)).filter("_first = 1").drop("_first")


def collapse_keys() -> Column:
    """What two listings are compared on."""
    title = normalize_text(F.coalesce("title", F.lit("")))
    return F.struct(
        listing_url_key(F.coalesce("url", F.lit(""))).alias("url"),
        normalize_text(F.coalesce("city", F.lit(""))).alias("city"),
        F.col("price_eur").alias("price"),
        F.col("rooms").alias("rooms"),
        title.alias("title"),
        title_tokens(title).alias("tokens"),
    )


def _prices_agree(a: Column, b: Column) -> Column:
    tolerance = F.greatest(F.lit(PRICE_FLOOR), round_half_up(F.least(a, b) * F.lit(PRICE_SHARE)))
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))


def near_duplicate(a: Column, b: Column) -> Column:
    """Compatible city, price and rooms, and equal or largely shared titles."""
    city_a, city_b = a["city"], b["city"]
    return (
        ((city_a == "") | (city_b == "") | F.contains(city_a, city_b) | F.contains(city_b, city_a))
        & _prices_agree(a["price"], b["price"])
        & F.coalesce(F.abs(a["rooms"] - b["rooms"]) <= 1, F.lit(True))
        & (a["title"] != "")
        & (b["title"] != "")
        & ((a["title"] == b["title"]) | overlap_at_least(a["tokens"], b["tokens"], MIN_OVERLAP))
    )


def collapse_duplicates(candidates: DataFrame, key: str = "search_id") -> DataFrame:
    """Keep-first collapse per search: one output row per search.

    ``candidates`` carries a total order (``listing_order`` plus ``arrival``). A row is
    dropped when an earlier kept row has its URL or is its near duplicate; dropped rows
    block nothing, so this is a fold over the ordered list and not a connected-component
    problem. The list is bounded: a search keeps at most 5 places x 13 portals x 50 rows
    (or 13 x 200 without a place), so folding it inside one row is safe at any table size.

    Output: ``key``, ``kept`` (ordered array of rows), ``removed``, ``total``.
    """
    window = Window.partitionBy(key).orderBy(*listing_order(), F.col("arrival"))
    payload = F.struct(*[F.col(c) for c in candidates.columns if c != key])
    listed = (
        candidates.select(key, payload.alias("row"), collapse_keys().alias("k"), F.row_number().over(window).alias("pos"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "k", "row"))).alias("items"))
    )
    light = F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), x["k"].alias("k")))
    kept = F.aggregate(
        light,
        F.slice(light, 1, 0),
        lambda acc, x: F.when(
            F.exists(acc, lambda e: (e["k"]["url"] == x["k"]["url"]) | near_duplicate(x["k"], e["k"])), acc
        ).otherwise(F.array_append(acc, x)),
    )
    folded = listed.withColumn("kept_pos", F.transform(kept, lambda x: x["pos"]))
    return folded.select(
        key,
        F.transform("kept_pos", lambda p: F.element_at(F.col("items"), p)["row"]).alias("kept"),
        (F.size("items") - F.size("kept_pos")).alias("removed"),
        F.size("kept_pos").alias("total"),
    )
