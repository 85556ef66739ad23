"""Additive relevance score with ordered reasons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost import rules
from roost.functions.numbers import extract_floor, extract_floor_loose, round_half_up
from roost.functions.text import contains_term, fold_accents, let, normalize_text, says
from roost.operators import filters as flt

# Columns added by prepare_listings; dropped again before rows are published.
PREPARED = [
    "city_norm", "path_lower", "floor_no", "floor_loose", "light_text", "exterior_text", "window_text",
    "orientation_text", "renovation_text", "search_text",
]


def prepare_listings(listings: DataFrame, text_signals: bool = True, hints: bool = True, hint_words: list[str] | None = None) -> DataFrame:
    """Everything about a listing that does not depend on the search, computed once per listing.

    ``text_signals`` and ``hints`` can be switched off when no search of the batch asks
    for them, which keeps the long texts out of the scan. ``hint_words``, where given, are all words of the hints:
    a description without one of them is not brought into words.
    """
    empty = F.lit("")
    chars = F.coalesce(F.col("chars"), F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.coalesce("description", empty)), chars), " ")
    own = F.coalesce("description", empty)
    listings = listings.withColumns({"_text": F.lower(text)})
    path = F.coalesce("source_path", empty)
    no_signal = F.lit(False)

    # patterns run case-sensitively over text lower-cased once: several times cheaper than
    # a case-folding match at every position
    def signal(pattern: str, source: Column | None = None) -> Column:
        said = says(F.col("_text"), rules.lower_pattern(pattern))
        # what a part says the whole says: most parts are not looked at
        said = said if source is None else said & says(F.lower(source), rules.lower_pattern(pattern))
        return F.coalesce(said, no_signal) if text_signals else no_signal

    before = F.concat_ws(" ", F.coalesce("city", empty), F.coalesce("title", empty))
    after = F.array_join(F.concat(chars, F.array(path)), " ")
    return listings.select(
        "*",
        normalize_text(F.coalesce("city", empty)).alias("city_norm"),
        F.lower(path).alias("path_lower"),
        extract_floor(chars).alias("floor_no"),
        extract_floor_loose(chars).alias("floor_loose"),
        signal(rules.LIGHT).alias("light_text"),
        signal(rules.EXTERIOR).alias("exterior_text"),
        signal(rules.WINDOWS).alias("window_text"),
        signal(rules.ORIENTATION).alias("orientation_text"),
        signal(rules.RENOVATION_TEXT, own).alias("renovation_text"),
        (_search_text(before, own, after, hint_words) if hints else empty).alias("search_text"),
    ).drop("_text")


def _search_text(before: Column, long: Column, after: Column, wanted: list[str] | None) -> Column:
    """``normalize_text`` of the three texts; a bar stands for the ``long`` one where it has words but none of the ``wanted`` ones.

    No term reaches over the bar, so nothing else is found, and a term that begins or ends in the long text has a word in it.
    """
    whole = normalize_text(F.concat_ws(" ", before, long, after))
    if wanted is None:
        return whole
    held = lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in wanted], F.lit(False))
    silent = long.rlike("[A-Za-z0-9]") & ~let(long, lambda t: held(F.lower(fold_accents(t))))
    return F.when(silent, F.concat_ws(" | ", normalize_text(before), normalize_text(after))).otherwise(whole)


def _q(name: str) -> Column:
    return F.col(f"q.{name}")


def _non_zero(c: Column) -> Column:
    """Known and not 0: two score rules skip a zero as if it were missing."""
    return F.coalesce(c != 0, F.lit(False))


def matched_tags() -> Column:
    own = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    return F.filter(_q("tags"), lambda t: F.array_contains(own, F.lower(t)))


def matched_hints() -> Column:
    return F.filter(
        F.coalesce(_q("location_hints"), F.array().cast("array<string>")),
        lambda h: (normalize_text(h) != "") & (F.col("search_text") != "") & contains_term(F.col("search_text"), normalize_text(h)),
    )


def light_intent() -> Column:
    wanted = F.transform(_q("tags"), F.lower)
    return F.arrays_overlap(wanted, F.array(*[F.lit(t) for t in rules.LIGHT_TAGS]))


def score_rules(
    city: Column, tags: Column, hints: Column, images: Column, signal: Callable[[str], Column]
) -> list[tuple[str, Column, Column | int, Column | str | None]]:
    """(name, condition, points, reason or None) of every rule, in the order the reasons are listed.

    The arguments stand for what is not a plain number of the listing: matched tags and hints, and text signals by name.
    With the most they can be, the sum is an upper bound of the score, with the least a lower one.
    """
    light = F.coalesce(light_intent(), F.lit(False))
    floor = F.col("floor_no")
    price_known = _non_zero(_q("max_price_eur")) & _non_zero(F.col("price_eur"))
    ratio = F.lit(1) - F.col("price_eur") / _q("max_price_eur")
    room_delta = F.col("rooms") - _q("min_rooms")
    rooms_hit = _non_zero(_q("min_rooms")) & _non_zero(F.col("rooms")) & F.coalesce(room_delta >= 0, F.lit(False))
    capacity_hit = _q("min_capacity_people").isNotNull() & F.col("capacity_people").isNotNull()
    high = light & F.coalesce(floor >= 5, F.lit(False))
    floor_text = floor.cast("string")
    exterior = F.coalesce(_q("prefer_exterior"), F.lit(False))
    renovation = F.coalesce(_q("renovation_ok"), F.lit(False))
    hint_text = F.concat(F.lit("Location hint match: "), F.array_join(F.slice(hints, 1, 3), ", "))
    return [
        ("city", city, 20, "City exact match"),
        ("nearby", ~city & flt.has_city() & flt.nearby(), 8, "Nearby towns accepted"),
        ("price", price_known, F.greatest(F.lit(0), F.least(F.lit(15), round_half_up(ratio * 15))), "Within budget"),
        ("rooms", rooms_hit, F.least(F.lit(10.0), room_delta * 2 + 4), "Rooms requirement satisfied"),
        ("capacity", capacity_hit, 8, "Capacity requirement satisfied"),
        ("tags", F.size(tags) > 0, F.size(tags) * 4, F.concat(F.lit("Tag matches: "), F.array_join(tags, ", "))),
        ("hints", F.size(hints) > 0, F.least(F.lit(12), F.size(hints) * 5), hint_text),
        ("images", F.lit(True), F.least(F.lit(4), F.floor(F.coalesce(images, F.lit(0)) / 2)), None),
        (
            "room_count",
            _q("min_rooms").isNull() & F.col("rooms").isNotNull(),
            F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.col("rooms") - 2)),
            None,
        ),
        ("high", high, 6, F.concat(F.lit("High floor ("), floor_text, F.lit("ª) supports natural light"))),
        ("light_exterior", light & signal("exterior_text"), 6, "Exterior layout mention"),
        ("light", light & signal("light_text"), 5, "Natural light / bright description"),
        ("windows", light & signal("window_text"), 4, "Large windows mention"),
        ("orientation", light & signal("orientation_text"), 4, "Orientation signal present"),
        ("exterior", exterior & signal("exterior_text"), 5, "Exterior preference satisfied"),
        (
            "floor",
            F.coalesce(floor >= _q("min_floor"), F.lit(False)),
            2,
            F.concat(F.lit("Floor requirement satisfied ("), floor_text, F.lit("ª)")),
        ),
        ("renovation", renovation & signal("renovation_text"), 3, "Renovation-friendly description"),
    ]


def points_of(rules_used: list) -> Column:
    """Sum of the rules that hold, from 45, within 0..100."""
    total: Column = F.lit(45.0)
    for _, condition, points, _ in rules_used:
        amount = points if isinstance(points, Column) else F.lit(points)
        total = total + F.when(condition, amount.cast("double")).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).cast("int")


def reasons_of(rules_used: list) -> Column:
    reasons = [
        F.when(condition, reason if isinstance(reason, Column) else F.lit(reason))
        for _, condition, _, reason in rules_used
        if reason is not None
    ]
    return F.array_compact(F.array(*reasons))


def with_score(candidates: DataFrame, open_floor: bool = False, images: Column | None = None, hints: Column | None = None) -> DataFrame:
    """Add ``score`` (0..100) and ``why_matched``.

    With ``open_floor`` also ``score_open`` and ``why_open``: the same without the floor
    bound, for searches whose floor rules get relaxed. ``images`` and ``hints`` (matched ones) may be known already.
    """
    base = candidates.withColumns(
        {
            "_city": flt.has_city() & flt.city_match(),
            "_tags": matched_tags(),
            "_hints": matched_hints() if hints is None else hints,
        }
    )
    images = F.size("image_urls") if images is None else images
    parts = score_rules(F.col("_city"), F.col("_tags"), F.col("_hints"), images, F.col)
    added = {"score": points_of(parts), "why_matched": reasons_of(parts)}
    if open_floor:
        without = [part for part in parts if part[0] != "floor"]
        added |= {"score_open": points_of(without), "why_open": reasons_of(without)}
    return base.withColumns(added).drop("_city", "_tags", "_hints")
