"""Bounded top-k of a search batch: block index, score bounds, and texts only for rows that can still be picked."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost import rules
from roost.functions.text import contains_term, normalize_text
from roost.operators import filters as flt
from roost.operators.rank import NO_PRICE, listing_order
from roost.operators.score import matched_tags, points_of, prepare_listings, score_rules, with_score
from roost.sources.staging import stage

if TYPE_CHECKING:
    from roost.operators.search import PlanProfile

#: What tells one listing row from another.
ROW = ["canonical_id", "seq"]
BLOCK = ["portal", "location_key", "kind", "band", "room_band"]
SIGNALS = ["light_text", "exterior_text", "window_text", "orientation_text", "renovation_text"]
BAND_EUR = 50_000
#: Up to so many different hints of a batch are looked up in every text that is read.
FEW_HINTS = 64
#: Bits of the fixed map that stands for keys too many to be sent to all tasks: 32 MB.
KEY_BITS = 1 << 28
#: Bits of a part of the map, as ``bitmap_construct_agg`` builds them.
PART_BITS = 1 << 15
#: Up to so many (task, listing) rows have their texts read in one round, and times its cap a task reads in the first of two.
READ_AT_ONCE = 400_000
READ_FIRST = 10
_TEXTS = "array<string>"


def _q(name: str) -> Column:
    return F.col(f"q.{name}")


def with_row_key(listings: DataFrame) -> DataFrame:
    return listings.withColumn("seq", F.coalesce("seq", F.lit(-1).cast("bigint")))


def listing_facts(listings: DataFrame) -> DataFrame:
    """The numbers and short texts of a listing that bounds and constraints need; no description is read."""
    prepared = prepare_listings(with_row_key(listings), text_signals=False, hints=False)
    images = F.coalesce(F.size("image_urls"), F.lit(0)).alias("n_images")
    return prepared.select(
        *ROW, "portal", "crawl_location", "price_eur", "rooms", "capacity_people", "property_type", "tags", images, "last_seen_at",
        "city_norm", "path_lower", "floor_no", "floor_loose",
    )


def with_blocks(keyed: DataFrame) -> DataFrame:
    """Rows with the rest of their block: type, price band and, where a key means a whole portal, rooms."""
    anywhere = F.col("location_key") == rules.DISCOVERY
    return keyed.withColumns(
        {
            "kind": F.coalesce("property_type", F.lit("")),
            "band": F.coalesce(F.floor(F.col("price_eur") / BAND_EUR), F.lit(-1)).cast("long"),
            "room_band": F.when(anywhere, F.least(F.lit(9), F.floor("rooms"))).cast("int"),
        }
    ).withColumn("room_band", F.coalesce("room_band", F.lit(-1)))


def block_index(facts: DataFrame) -> DataFrame:
    """One row per block: its size, and the best of everything that its listings could bring to a score."""
    lowered = F.transform(F.coalesce("tags", F.array().cast(_TEXTS)), F.lower)
    return facts.groupBy(*BLOCK).agg(
        F.count("*").alias("n"),
        F.min("price_eur").alias("least_price"),
        F.min(F.when(F.col("price_eur") > 0, F.col("price_eur"))).alias("price_eur"),
        F.bool_or(F.col("price_eur").isNull()).alias("some_unpriced"),
        F.max("rooms").alias("rooms"),
        F.bool_or(F.col("rooms").isNull()).alias("some_roomless"),
        F.max("capacity_people").alias("capacity_people"),
        F.max("n_images").alias("n_images"),
        F.max("floor_no").alias("floor_no"),
        F.array_distinct(F.flatten(F.collect_set(lowered))).alias("tags"),
    )


def _hint_bound() -> Column:
    return F.coalesce(_q("location_hints"), F.array().cast(_TEXTS))


def _most(city: Column) -> Column:
    """Upper bound of the score: every text signal and every hint."""
    return points_of(score_rules(city, matched_tags(), _hint_bound(), F.col("n_images"), lambda _: F.lit(True)))


def _least(city: Column) -> Column:
    """Lower bound of the score: no text says anything."""
    return points_of(score_rules(city, matched_tags(), F.array().cast(_TEXTS), F.col("n_images"), lambda _: F.lit(False)))


def _may_hold() -> Column:
    """Whether some listing of a block can meet the hard constraints."""

    def bounded(bound: Column, some_unknown: Column, holds: Column) -> Column:
        return bound.isNull() | F.coalesce(holds, F.lit(False)) | (some_unknown & ~flt.strict())

    kind = F.nullif(F.col("kind"), F.lit(""))
    wanted = _q("property_types")
    by_type = F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, True).when(kind.isNull(), ~flt.strict()).otherwise(F.array_contains(wanted, kind))
    return (
        bounded(_q("max_price_eur"), F.col("some_unpriced"), F.col("least_price") <= _q("max_price_eur"))
        & bounded(_q("min_rooms"), F.col("some_roomless"), F.col("rooms") >= _q("min_rooms"))
        & (_q("min_capacity_people").isNull() | F.coalesce(F.col("capacity_people") >= _q("min_capacity_people"), F.lit(False)))
        & by_type
    )


def _open(blocks: DataFrame, facts: DataFrame, known: DataFrame, task: list[str], few: bool, small: bool) -> DataFrame:
    """Listings of the opened (task, block) rows that meet the constraints, with both bounds of their score.

    What is asked is joined by task (``known``) and not carried by every block, unless the tasks are too many to be sent.
    """
    opened = blocks.select(*task, *BLOCK)
    if small:
        rows = facts.join(F.broadcast(opened) if few else opened, BLOCK).join(F.broadcast(known), task)
    else:
        rows = facts.join(opened.join(known, task), BLOCK)
    rows = rows.filter(flt.base_ok()).withColumn("floor_pass", flt.floor_ok())
    rows = rows.filter(F.col("floor_pass") | F.col("relaxable")).withColumn("_city", flt.has_city() & flt.city_match())
    return rows.withColumns({"least": _least(F.col("_city")), "most": _most(F.col("_city"))}).drop("_city", "q", "relaxable", *BLOCK[1:], "floor_loose")


def _tie() -> list[Column]:
    """What decides between equal scores, up to the id, as numbers that are never null."""
    return [
        F.coalesce("price_eur", F.lit(NO_PRICE)),
        F.coalesce("rooms", F.lit(-1.0)),
        F.coalesce(F.unix_micros("last_seen_at"), F.lit(-(1 << 63))),
    ]


BAR = ["bar", "bar_price", "bar_rooms", "bar_seen"]


def _bars(rows: DataFrame, task: list[str], most_rows: int) -> DataFrame:
    """Per task the lower bound, and the place among equal ones, that ``cap`` rows reach; tasks with fewer rows have none."""
    best = Window.partitionBy(*task).orderBy(F.desc("least"), *listing_order()[1:-1])
    cut = rows.select(*task, "cap", "least", "price_eur", "rooms", "last_seen_at").withColumn("n", F.row_number().over(best))
    price, room, seen = _tie()
    return cut.filter(F.col("n") <= most_rows).filter("n = cap").select(
        *task, F.col("least").alias("bar"), price.alias("bar_price"), room.alias("bar_rooms"), seen.alias("bar_seen")
    )


def _reaches_bar() -> Column:
    """Whether a row can come before the row that sets the bar: more points, or as many and not behind it among equals."""
    price, room, seen = _tie()
    bar_price, bar_room = F.col("bar_price"), F.col("bar_rooms")
    level = (price < bar_price) | ((price == bar_price) & ((room > bar_room) | ((room == bar_room) & (seen >= F.col("bar_seen")))))
    return F.col("bar").isNull() | (F.col("most") > F.col("bar")) | ((F.col("most") == F.col("bar")) & level)


def surviving_rows(facts: DataFrame, tasks: DataFrame, stats: DataFrame, task: list[str], most_rows: int, small: bool, small_bytes: int) -> DataFrame:
    """Every listing that can be among the first ``cap`` of a task, and few others.

    Each task meets the blocks of its portal and place. The blocks of the highest upper bounds are opened first, until they
    hold twice the cap; the lower bound that ``cap`` of their rows reach closes all blocks strictly below it, and
    the rest is opened. Of rows that can at best draw level with the bar, only those stay that the order of equal scores does
    not put behind it. No row that belongs to the answer is lost, ties included: a task whose rows
    may be relaxed and whose place has floors for some listings only keeps all its blocks.
    """
    facts_of_task = tasks.select(*task, "portal", "location_key", "q", "cap").join(stats, ["portal", "location_key"])
    relaxable = flt.has_floor_filters() & (F.col("with_floor") == 0)
    known = facts_of_task.withColumns({"relaxable": relaxable, "open_all": relaxable & (F.col("with_floor_no") > 0)})
    known = known.drop("candidates", "with_floor", "with_floor_no")
    index = block_index(facts)
    met = index.join(F.broadcast(known) if small else known, ["portal", "location_key"]).filter(_may_hold())
    # numbers of a block stand for its best listing; any of its places may be the searched one
    met = met.withColumn("most", _most(flt.has_city()))
    before = Window.partitionBy(*task).orderBy(F.desc("most"), *BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    dealt = stage(
        met.withColumn("early", F.coalesce(F.sum("n").over(before), F.lit(0)) < 2 * F.col("cap"))
        .select(*task, "open_all", "most", "early", *BLOCK, "least_price"),
        "blocks",
    )
    # the listings stay where they are while the (task, block) rows can be sent to all tasks
    width = F.octet_length(F.to_json(F.struct(*task))) + F.octet_length(F.concat_ws("", "portal", "location_key", "kind")) + 100
    size = dealt.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    few = small and size <= small_bytes
    asked = stage(known.select(*task, "q", "cap", "relaxable"), "asked")
    first = stage(_open(dealt.filter("early"), facts, asked, task, few, small), "first-rows")
    sent = lambda bars: F.broadcast(bars) if small else bars
    bars = stage(_bars(first, task, most_rows), "first-bars")
    later = dealt.filter("not early").join(sent(bars), task, "left")
    later = later.withColumn("bar", F.when(~F.coalesce("open_all", F.lit(False)), F.col("bar")))
    cheap = F.coalesce("least_price", F.lit(NO_PRICE)) <= F.col("bar_price")
    later = later.filter(F.col("bar").isNull() | (F.col("most") > F.col("bar")) | ((F.col("most") == F.col("bar")) & cheap))
    # a task that opens all its blocks has no bar
    open_all = stage(dealt.filter("open_all").select(*task).distinct(), "open-all")
    barred = asked.join(sent(bars.join(sent(open_all), task, "left_anti")), task, "left")
    rest = _open(later, facts, barred, task, few, small).filter(_reaches_bar()).drop(*BAR)
    rows = first.unionByName(stage(rest, "later-rows"))
    bars = stage(_bars(rows, task, most_rows).join(sent(open_all), task, "left_anti"), "bars")
    # the rows are not moved for one bar per task
    left = rows.join(sent(bars), task, "left").filter(_reaches_bar()).withColumn("barred", F.col("bar").isNotNull())
    return stage(left.drop(*BAR, "least"), "survivors")


def _hints_held(hints: Column) -> Column:
    text = F.col("search_text")
    return F.filter(hints, lambda h: (normalize_text(h) != "") & (text != "") & contains_term(text, normalize_text(h)))


def _digest(columns: list[str]) -> Column:
    """Tells rows of one key apart, so that their signals and their texts are taken from the same one."""
    return F.xxhash64(*columns).alias("digest")


def key_map(wanted: DataFrame) -> DataFrame:
    """(bits): one row, a map of fixed size with the bits that the hashed keys of ``wanted`` set, in parts by their number."""
    at = _key_bit()
    parts = wanted.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("set"))
    # parts are numbered from 1; those without a key are null
    every = wanted.sparkSession.range(1, KEY_BITS // PART_BITS + 1, 1, 1).withColumnRenamed("id", "part").join(F.broadcast(parts), "part", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "set"))), lambda p: p["set"]).alias("bits"))


def _key_bit() -> Column:
    return F.pmod(F.xxhash64(*ROW), F.lit(KEY_BITS))


def _in_map(bits: Column) -> Column:
    position = F.bitmap_bit_position(_key_bit())
    octet = F.substring(F.get(bits, (F.bitmap_bucket_number(_key_bit()) - 1).cast("int")), F.floor(position / 8).cast("int") + 1, F.lit(1))
    return F.coalesce(F.getbit(F.conv(F.hex(octet), 16, 10).cast("int"), (position % 8).cast("int")) == 1, F.lit(False))


def rows_of_keys(listings: DataFrame, wanted: DataFrame, size: int, small_bytes: int) -> DataFrame:
    """Listings whose key is in ``wanted``; where the keys are many, also some whose key shares a bit with one of them.

    The map of the keys is a condition on the key alone, which Spark tests where the key is read, in front of the joins that
    bring the texts. A join by key stays behind them: only what the map lets through is moved.
    """
    rows = with_row_key(listings).filter(_in_map(key_map(wanted).scalar()))
    return rows.join(F.broadcast(wanted), ROW, "left_semi") if size <= small_bytes else rows


def read_signals(listings: DataFrame, survivors: DataFrame, tasks: DataFrame, task: list[str], signals: bool, hints: bool, small_bytes: int) -> DataFrame:
    """Text signals of the surviving listings and the hints of the batch that they hold, one narrow row each.

    Patterns run where the texts are read, and no text is written or moved by key: the surviving keys only filter the
    listings (``rows_of_keys``; signals of the few others that it lets through meet no surviving row). Only a batch of very
    many different hints brings each listing the ones that its own tasks ask for.
    """
    asked = survivors.select(*ROW, *task)
    wanted = stage(asked.select(*ROW).distinct(), "wanted")
    size = wanted.agg(F.coalesce(F.sum(F.length("canonical_id") + 60), F.lit(0))).first()[0]
    rows = rows_of_keys(listings, wanted, size, small_bytes)
    none = F.array().cast(_TEXTS)
    named = tasks.select(*task, F.explode("q.location_hints").alias("hint")).filter("hint IS NOT NULL") if hints else None
    spelled = named.select("hint", normalize_text("hint").alias("words")).distinct().limit(FEW_HINTS + 1).collect() if hints else []
    known = [r.hint for r in spelled]
    words = sorted({w for r in spelled for w in r.words.split(" ")} - {""})
    of_batch = F.array(*[F.lit(h) for h in known]).cast(_TEXTS) if known else none
    if len(known) > FEW_HINTS:
        rows = rows.join(asked.join(named, task).groupBy(*ROW).agg(F.collect_set("hint").alias("asked_hints")), ROW, "left")
        of_batch = F.coalesce("asked_hints", none)
        words = None
    prepared = prepare_listings(rows, text_signals=signals, hints=hints, hint_words=words)
    said = prepared.select(*ROW, _digest(listings.columns), *SIGNALS, (_hints_held(of_batch) if hints else none).alias("held_hints"))
    one = said.groupBy(*ROW).agg(F.min_by(F.struct("digest", *SIGNALS, "held_hints"), "digest").alias("said"))
    return stage(one.select(*ROW, "said.*"), "signals")


def read_in_rounds(
    listings: DataFrame, survivors: DataFrame, tasks: DataFrame, task: list[str], profile: PlanProfile, small_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """The surviving rows that can be picked, and what the texts of their listings say (``read_signals``).

    Many rows are read in two rounds: a task first reads its most promising rows, a few times its cap. The score that
    ``cap`` of these have bars all other rows whose upper bound stays below it, as in ``surviving_rows`` but with what the
    texts say counted, so only few of the others are read. Rows of tasks without a bar are all read.
    """
    numbers = ["most", "cap", "barred"]

    def read(rows: DataFrame) -> DataFrame:
        return read_signals(listings, rows, tasks, task, profile.signals, profile.hints, small_bytes)

    if survivors.count() <= READ_AT_ONCE:
        return survivors.drop(*numbers), read(survivors)
    best = Window.partitionBy(*task).orderBy(F.desc("most"), *listing_order()[1:-1])
    most_rows = READ_FIRST * profile.max_cap
    first = survivors.filter("barred").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most_rows).filter(F.col("n") <= READ_FIRST * F.col("cap"))
    first = stage(first.drop("n"), "read-first")
    said = read(first)
    scored = score_survivors(first.drop(*numbers), said, tasks, task, profile.small, False)
    bars = stage(_bars(scored.withColumnRenamed("score", "least"), task, profile.max_cap), "exact-bars")
    left = survivors.join(F.broadcast(bars) if profile.small else bars, task, "left").filter(_reaches_bar())
    left = stage(left.drop(*BAR, *numbers), "left")
    return left, said.unionByName(read(left.join(said.select(*ROW), ROW, "left_anti")))


def read_rows(listings: DataFrame, picked: DataFrame, small_bytes: int) -> DataFrame:
    """Whole rows of the picked listings, each written once."""
    wanted = stage(picked.select(*ROW, "digest").distinct(), "picked-keys")
    size = wanted.agg(F.coalesce(F.sum(F.length("canonical_id") + 60), F.lit(0))).first()[0]
    rows = rows_of_keys(listings, wanted.select(*ROW), size, small_bytes)
    rows = rows.withColumn("digest", _digest(listings.columns))
    rows = rows.join(F.broadcast(wanted) if size <= small_bytes else wanted, [*ROW, "digest"], "left_semi")
    return stage(rows.drop("digest").dropDuplicates(ROW), "texts")


def score_survivors(survivors: DataFrame, rows: DataFrame, tasks: DataFrame, task: list[str], small: bool, open_floor: bool) -> DataFrame:
    """Exact scores and reasons, still without any listing text."""
    said = rows.select(*ROW, "digest", *SIGNALS, "held_hints")
    # what a task asks comes last: rows that move by key do not carry it
    whole = survivors.drop("portal").join(said, ROW).join(F.broadcast(tasks) if small else tasks, task)
    matched = F.filter(_hint_bound(), lambda h: F.array_contains("held_hints", h))
    scored = with_score(whole, open_floor=open_floor, images=F.col("n_images"), hints=matched)
    return scored.withColumn("locale", F.col("q.locale")).drop(
        "q", "discovery", *SIGNALS, "held_hints", "n_images", "city_norm", "path_lower", "floor_no", "capacity_people", "property_type", "tags",
        "crawl_location",
    )
