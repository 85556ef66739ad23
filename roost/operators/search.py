"""Batch search: saved searches x stored listings -> ranked, collapsed, explained results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roost import rules
from roost.functions.text import normalize_text, unique_strings
from roost.operators import filters as flt
from roost.operators.dedupe import collapse_duplicates, first_by_key
from roost.operators.rank import listing_order, top_per_group
from roost.operators.prune import ROW, listing_facts, read_in_rounds, read_rows, score_survivors, surviving_rows, with_blocks
from roost.plans.search_plan import criteria_for, plan_requests, plan_tasks, union_all
from roost.sources.staging import stage

BROADCAST_BYTES = 64 << 20
SALTS = 16
RUN = "run_id"
TASK = [RUN, "loc_pos", "src_pos"]
_NONE = "array<string>"
#: Listing columns that the order and the collapse need; the others are joined to the final rows.
COMPARED = [*ROW, "portal", "portal_listing_id", "url", "title", "city", "price_eur", "rooms", "last_seen_at"]


class SearchOutput:
    """Result tables of a batch of searches, all keyed by ``search_id``.

    The passes over the listings run once, when the first table that needs them is asked for: ``failures`` and
    ``action_required`` hang on the tasks and on what reading the portals gave alone.
    """

    def __init__(self, requests: DataFrame, tasks: DataFrame, passes: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]) -> None:
        self._requests, self._tasks, self._passes = requests, tasks, passes

    def _publish(self, of_runs: DataFrame) -> DataFrame:
        return self._requests.select("search_id", RUN).join(of_runs, RUN).drop(RUN)

    @cached_property
    def _of_runs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._passes()

    @cached_property
    def results(self) -> DataFrame:
        return self._publish(self._of_runs[0])

    @cached_property
    def coverage(self) -> DataFrame:
        return self._publish(self._of_runs[1])

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self._publish(self._of_runs[2].join(_failures(self._tasks).select(RUN), RUN, "left_anti"))

    @cached_property
    def failures(self) -> DataFrame:
        return self._publish(_failures(self._tasks))

    @cached_property
    def action_required(self) -> DataFrame:
        return _action_required(self._requests)


@dataclass
class PlanProfile:
    """One row of facts about the task table that decide the physical plan."""

    rows: int
    size: int
    located: bool
    discovery: bool
    max_words: int
    max_slug: int
    hints: bool
    signals: bool
    floors: bool
    max_cap: int

    @property
    def small(self) -> bool:
        return self.size <= BROADCAST_BYTES


def profile_tasks(tasks: DataFrame) -> PlanProfile:
    """A single aggregate over the task table; its size guards every broadcast below."""
    q = lambda n: F.col(f"q.{n}")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    wants = (
        F.arrays_overlap(F.transform(q("tags"), F.lower), F.array(*[F.lit(t) for t in rules.LIGHT_TAGS]))
        | F.coalesce(q("prefer_exterior"), F.lit(False))
        | F.coalesce(q("renovation_ok"), F.lit(False))
    )
    row = tasks.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size"),
        some(~F.col("discovery")).alias("located"),
        some(F.col("discovery")).alias("discovery"),
        F.coalesce(F.max(F.size(F.split("location_key", " "))), F.lit(1)).alias("max_words"),
        F.coalesce(F.max(F.length(q("city_slug"))), F.lit(1)).alias("max_slug"),
        some(F.size(q("location_hints")) > 0).alias("hints"),
        some(wants).alias("signals"),
        some(flt.has_floor_filters()).alias("floors"),
        F.coalesce(F.max("cap"), F.lit(1)).cast("int").alias("max_cap"),
    ).first()
    return PlanProfile(**row.asDict())


def sized_join(big: DataFrame, small: DataFrame, on: list[str], is_small: bool, how: str = "inner") -> DataFrame:
    """Equi-join that broadcasts ``small`` when its measured size allows.

    Beyond that, ``big`` is salted and ``small`` repeated per salt, so that one key
    holding a large share of all rows is spread over ``SALTS`` shuffle partitions.
    """
    if is_small:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64("canonical_id"), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def add_city_keys(listings: DataFrame, max_words: int, max_slug: int) -> DataFrame:
    """One row per place key a listing can match as whole words of its city text.

    Whole-word containment of a term equals "some run of words equals the term", so runs
    up to the longest searched term turn the containment into an exact equi-join. A
    listing without city text matches through ``<slug>_capital`` in its source path: the
    keys are then all tails, up to the longest slug, of the text in front of ``_capital``.
    """
    words = F.split("city_norm", " ")
    n = F.size(words)
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(n, F.lit(max_words))),
            lambda size: F.transform(
                F.sequence(F.lit(1), n - size + 1), lambda start: F.array_join(F.slice(words, start, size), " ")
            ),
        )
    )
    heads = F.transform(
        F.regexp_extract_all("path_lower", F.lit(r"([a-z0-9_]*)(?=_capital)"), F.lit(1)), lambda h: F.rtrim(h)
    )
    tails = F.flatten(
        F.transform(
            F.filter(heads, lambda h: h != ""),
            lambda h: F.transform(
                F.sequence(F.lit(1), F.least(F.length(h), F.lit(max_slug))),
                lambda size: F.replace(F.right(h, size), F.lit("_"), F.lit(" ")),
            ),
        )
    )
    keys = F.when(F.col("city_norm") != "", runs).otherwise(tails)
    return listings.withColumn("location_key", F.explode(F.array_distinct(keys)))


def match_listings(prepared: DataFrame, tasks: DataFrame, profile: PlanProfile, scope: str) -> DataFrame:
    """Listings of the portal and place of every task."""
    branches = []
    if profile.located or not profile.discovery:
        keyed = (
            prepared.withColumn("location_key", normalize_text(F.col("crawl_location")))
            if scope == "crawl"
            else add_city_keys(prepared, profile.max_words, profile.max_slug)
        )
        located = tasks.filter(~F.col("discovery")) if profile.discovery else tasks
        branches.append(sized_join(keyed, located, ["portal", "location_key"], profile.small))
    if profile.discovery:
        anywhere = tasks.filter("discovery")
        branches.append(sized_join(prepared, anywhere, ["portal"], profile.small))
    out = branches[0]
    for other in branches[1:]:
        out = out.unionByName(other)
    return out


def listing_stats(facts: DataFrame) -> DataFrame:
    """Per (portal, place): listings stored, and how many of them name a floor.

    Pre-aggregated per task, so a hot place costs one row per task in the shuffle.
    """
    return facts.groupBy("portal", "location_key").agg(
        F.count("*").alias("candidates"), F.count("floor_loose").alias("with_floor"), F.count("floor_no").alias("with_floor_no")
    )


def _shared_runs(requests: DataFrame) -> DataFrame:
    """Requests that ask the same question share one run: the key is a digest of all they ask."""
    asked = [c for c in requests.columns if c != "search_id"]
    return requests.withColumn(RUN, F.sha2(F.to_json(F.struct(*asked)), 256))


def run_search(
    searches: DataFrame,
    listings: DataFrame,
    outcomes: DataFrame | None = None,
    scope: str = "crawl",
    max_tasks: int = rules.MAX_SEARCH_TASKS,
) -> SearchOutput:
    """Run every saved search over the stored listings.

    Requests and tasks are staged here. The passes over the listings run once, when the first table that needs them is
    asked for, and are staged in the shared checkpoint folder; the returned tables read only the staged, bounded rows.

    ``outcomes`` holds what reading each (portal, place) gave (``schema.OUTCOME``); a pair
    with an error code contributes no listings. ``scope`` is ``crawl`` (listings belong to
    the place they were fetched for) or ``city`` (to every place their city text names).
    """
    requests = stage(_shared_runs(plan_requests(searches, max_tasks)), "requests")
    runs = requests.dropDuplicates([RUN]).drop("search_id")
    planned = stage(plan_tasks(runs, RUN), "tasks")

    if outcomes is not None:
        # one row per (portal, place); joined to the small task table, not to the listings
        tasks = planned.join(
            outcomes.select("portal", "location_key", "source_kind", "warnings", "error_code", "error_message"),
            ["portal", "location_key"],
            "left",
        )
    else:
        tasks = planned.withColumns(
            {
                "source_kind": F.lit(None).cast("string"),
                "warnings": F.lit(None).cast(_NONE),
                "error_code": F.lit(None).cast("string"),
                "error_message": F.lit(None).cast("string"),
            }
        )
    return SearchOutput(requests, tasks, lambda: _run_passes(listings, runs, tasks, profile_tasks(planned), scope))


def _run_passes(listings: DataFrame, runs: DataFrame, tasks: DataFrame, profile: PlanProfile, scope: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, coverage and diagnostics by run."""
    live = tasks.filter("error_code IS NULL").drop("source_kind", "warnings", "error_code", "error_message")

    picked, stats, whole_rows = staged_picks(listings, live, profile, scope)

    # everything below is keyed by run and holds at most 5 x 13 x 50 rows per run, without their texts
    per_run = picked.repartition(RUN)
    arrival = [F.col("loc_pos"), F.col("src_pos"), F.col("task_rank")]
    whole = Window.partitionBy(RUN)
    first_seen = first_by_key(
        per_run.withColumn("any_relaxed", F.bool_or(~F.col("floor_pass")).over(whole)),
        [RUN, "portal", "portal_listing_id"],
        arrival,
    ).withColumn("arrival", F.struct(*arrival))
    collapsed = collapse_duplicates(first_seen, RUN)

    texts = [c for c in listings.columns if c not in COMPARED]
    results = _final_rank(collapsed, profile).join(whole_rows.select(*ROW, *texts), ROW)
    coverage = _coverage(tasks, stats, picked)
    return results, coverage, _diagnostics(runs, coverage, collapsed)


def pick_rows(listings: DataFrame, live: DataFrame, profile: PlanProfile, scope: str) -> tuple[DataFrame, DataFrame]:
    """The first rows of every task, whole and with their scores, and the counts per place."""
    picked, stats, rows = staged_picks(listings, live, profile, scope)
    return picked.join(rows.drop(*[c for c in COMPARED if c not in ROW]), ROW), stats


def staged_picks(listings: DataFrame, live: DataFrame, profile: PlanProfile, scope: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first rows of every task with their scores, the counts per place, and the whole listings picked: all staged.

    Numbers first: bounds of the score from a block index decide which listings a task can still pick; only their texts
    are searched, those of the most promising ones first, and whole rows are read for what the top-k leaves.
    """
    # a number stands for the task in all rows of numbers; the digest of its run would be most of such a row
    live = stage(live.withColumn("task_no", F.monotonically_increasing_id()), "live")
    task = ["task_no"]
    facts = listing_facts(listings).withColumn("crawl_key", normalize_text(F.col("crawl_location")))
    # a listing is written once; that it is met under its place and anywhere is said when it is read
    facts = stage(facts, "numbers")
    keyed = []
    if profile.located or not profile.discovery:
        keyed.append(
            facts.withColumn("location_key", F.col("crawl_key")) if scope == "crawl" else add_city_keys(facts, profile.max_words, profile.max_slug)
        )
    if profile.discovery:
        keyed.append(facts.withColumn("location_key", F.lit(rules.DISCOVERY)))
    facts = with_blocks(union_all(keyed)).drop("crawl_key")
    if scope != "crawl":
        facts = stage(facts, "facts")
    stats = stage(listing_stats(facts), "stats")
    survivors = surviving_rows(facts, live, stats, task, profile.max_cap, profile.small, BROADCAST_BYTES)
    survivors, said = read_in_rounds(listings, survivors, live, task, profile, BROADCAST_BYTES)
    scored = score_survivors(survivors, said, live, task, profile.small, profile.floors)
    kept = [c for c in listings.columns if c not in (*ROW, "portal")]
    ranked = stage(_pick_per_task(scored, live, stats, profile).drop(*kept), "ranked")
    rows = read_rows(listings, ranked, BROADCAST_BYTES)
    return stage(ranked.drop("portal", "digest", "task_no").join(rows.select(*COMPARED), ROW), "picked"), stats, rows


def _pick_per_task(scored: DataFrame, live: DataFrame, stats: DataFrame, profile: PlanProfile) -> DataFrame:
    """Top rows of every (run, place, portal), with the floor rule relaxed where it must be.

    A task keeps rows that fail only the floor rule when nothing passes it and no listing
    of the task names a floor at all. Both kinds are cut to the cap first, so the test runs
    on a bounded number of rows.
    """
    ranked = top_per_group(
        scored, [*TASK, "floor_pass"], listing_order(), F.col("cap"), profile.max_cap, "task_rank"
    )
    if not profile.floors:
        return ranked
    facts = (
        live.filter(flt.has_floor_filters())
        .join(stats, ["portal", "location_key"])
        .filter("candidates > 0 AND with_floor = 0")
        .select(*TASK, F.lit(True).alias("no_floor_data"))
    )
    task = Window.partitionBy(*TASK)
    return (
        ranked.join(facts, TASK, "left")
        .withColumn("n_pass", F.count_if(F.col("floor_pass")).over(task))
        .filter(F.col("floor_pass") | ((F.col("n_pass") == 0) & F.coalesce("no_floor_data", F.lit(False))))
        .drop("no_floor_data", "n_pass")
    )


def _final_rank(collapsed: DataFrame, profile: PlanProfile) -> DataFrame:
    """Global order per run: best row of every place first when there are several places."""
    rows = collapsed.select(RUN, F.explode("kept").alias("r")).select(RUN, "r.*")
    if profile.floors:
        # a single-place run counts without floor rules once any of its tasks was relaxed
        relaxed = (F.col("n_places") == 1) & F.col("any_relaxed")
        rows = rows.withColumns(
            {
                "score": F.when(relaxed, F.col("score_open")).otherwise(F.col("score")),
                "why_matched": F.when(relaxed, F.col("why_open")).otherwise(F.col("why_matched")),
            }
        ).drop("score_open", "why_open")
    order = [*listing_order(), F.col("arrival")]
    several = F.col("n_places") > 1
    rows = rows.withColumn("place_rank", F.row_number().over(Window.partitionBy(RUN, "loc_pos").orderBy(*order)))
    slot = F.when(several & (F.col("place_rank") == 1), F.col("loc_pos")).otherwise(F.col("n_places"))
    ranked = rows.withColumn(
        "result_rank", F.row_number().over(Window.partitionBy(RUN).orderBy(slot, *order))
    ).filter(F.col("result_rank") <= F.col("cap_total"))
    return ranked.drop(
        "cap", "cap_total", "floor_pass", "task_rank", "arrival", "place_rank", "n_places", "any_relaxed", "location_key",
        "loc_pos", "src_pos",
    )


def _coverage(tasks: DataFrame, stats: DataFrame, picked: DataFrame) -> DataFrame:
    """One row per task: listings seen and returned, warnings, error."""
    returned = picked.groupBy(*TASK).agg(
        F.count("*").alias("returned"), F.bool_or(~F.col("floor_pass")).alias("relaxed")
    )
    joined = tasks.join(stats, ["portal", "location_key"], "left").join(returned, TASK, "left")
    failed = F.col("error_code").isNotNull()
    zero = F.lit(0).cast("bigint")
    candidates = F.when(failed, zero).otherwise(F.coalesce("candidates", zero))
    note = F.concat(
        F.lit("Auto-relaxed floor filters for "), F.col("portal"), F.lit(" in "), F.col("location"),
        F.lit(" because "), candidates.cast("string"), F.lit(" candidates lacked floor metadata."),
    )
    return joined.select(
        *TASK,
        "location",
        "portal",
        F.when(~failed, F.coalesce("source_kind", F.lit("scrape"))).alias("source"),
        candidates.alias("candidates"),
        F.when(failed, zero).otherwise(F.coalesce("returned", zero)).alias("returned"),
        F.when(failed, F.array().cast(_NONE)).otherwise(F.coalesce("warnings", F.array().cast(_NONE))).alias("warnings"),
        F.when(F.coalesce("relaxed", F.lit(False)) & ~failed, note).alias("relax_note"),
        "error_code",
        "error_message",
    )


def _failures(tasks: DataFrame) -> DataFrame:
    """Runs where every portal failed: the first error in place and portal order."""
    return (
        tasks.groupBy(RUN)
        .agg(
            F.bool_and(F.col("error_code").isNotNull()).alias("all_failed"),
            F.min_by(F.struct("error_code", "error_message"), F.struct("loc_pos", "src_pos")).alias("first"),
        )
        .filter("all_failed")
        .select(RUN, "first.error_code", "first.error_message")
    )


def _diagnostics(runs: DataFrame, coverage: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Counts, ordered warnings and the effective criteria of every run."""
    steps = coverage.groupBy(RUN).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "loc_pos", "src_pos", "location", "error_code",
                    F.concat("warnings", F.array_compact(F.array("relax_note"))).alias("notes"),
                )
            )
        ).alias("steps"),
        F.bool_or(F.col("relax_note").isNotNull()).alias("relaxed"),
        F.max(
            F.when(F.col("source") == "scrape", 3).when(F.col("source") == "live", 2).when(F.col("source") == "fixture", 1)
        ).alias("kind"),
    )
    totals = collapsed.select(RUN, "removed", "total")
    joined = runs.join(steps, RUN, "left").join(totals, RUN, "left")
    none = F.array().cast(_NONE)
    removed, total = F.coalesce("removed", F.lit(0)), F.coalesce("total", F.lit(0))
    several, nowhere = F.size("requested") > 1, F.size("requested") == 0
    n_portals = F.size("portals").cast("string")
    headline = (
        F.when(
            several,
            F.array(
                F.concat(
                    F.lit("Executed multi-location search across "), F.size("requested").cast("string"),
                    F.lit(" requested locations ("), F.col("n_places").cast("string"),
                    F.lit(" search locations) and "), n_portals, F.lit(" sources."),
                )
            ),
        )
        .when(
            nowhere,
            F.array(
                F.concat(
                    F.lit("No city/locations provided; running discovery search across "), n_portals,
                    F.lit(" sources because strict_constraints=false."),
                )
            ),
        )
        .otherwise(none)
    )
    removed_note = F.when(
        removed > 0,
        F.array(
            F.concat(F.lit("Deduplicated "), removed.cast("string"), F.lit(" near-identical listings before ranking."))
        ),
    ).otherwise(none)
    said = F.flatten(F.transform(F.coalesce("steps", F.array().cast("array<struct<loc_pos:int,src_pos:int,location:string,error_code:string,notes:array<string>>>")), lambda s: s["notes"]))
    run_notes = F.concat(headline, unique_strings(F.concat(said, removed_note)))
    fixed_notes = F.when(
        F.col("status") == "no_sources", F.array(F.lit(rules.NO_SOURCE_WARNING))
    ).otherwise(F.array(F.lit(rules.MISSING_LOCATION_WARNING), F.lit(rules.MISSING_LOCATION_ACTION)))
    running = F.col("status") == "run"
    searched = unique_strings(
        F.transform(F.filter("steps", lambda s: s["error_code"].isNull()), lambda s: s["location"])
    )
    return joined.select(
        RUN,
        "status",
        F.when(F.col("kind") == 3, "scrape").when(F.col("kind") == 2, "live").otherwise("fixture").alias("source"),
        F.when(running, run_notes).otherwise(fixed_notes).alias("connector_warnings"),
        "request_warnings",
        total.cast("bigint").alias("total_candidates"),
        F.least(total, F.col("cap_total")).cast("bigint").alias("returned_count"),
        F.col("requested").alias("locations_requested"),
        F.when(running, F.coalesce(searched, none)).otherwise(none).alias("locations_searched"),
        F.when(F.col("status") == "no_sources", none).otherwise(F.col("portals")).alias("sources"),
        F.when(F.size("requested") > 0, F.col("cap_place")).alias("per_location_limit"),
        F.col("cap_total").alias("max_results_total"),
        F.col("is_strict").alias("strict_constraints"),
        _effective_criteria().alias("criteria"),
    )


def _effective_criteria() -> Column:
    """Criteria of the final ranking: place and hints only for one place, no floor rules once relaxed."""
    one = (F.col("status") == "run") & (F.col("n_places") == 1)
    place = F.get("places", F.lit(0))
    relaxed = F.coalesce("relaxed", F.lit(False))
    named = one & (place["location"] != rules.DISCOVERY)
    base = criteria_for(
        F.when(named, place["location"]), F.when(one, place["hints"]).otherwise(F.array().cast(_NONE))
    )
    out = base.dropFields("city_norm", "city_slug")
    for field in ("min_floor", "exclude_ground_floor"):
        out = out.withField(field, F.when(~relaxed, base[field]))
    return out


def _action_required(requests: DataFrame) -> DataFrame:
    """Strict requests without a place: what the caller has to send."""
    return requests.filter("status = 'missing_locations'").select(
        "search_id",
        F.lit("MISSING_LOCATIONS").alias("code"),
        F.lit(rules.MISSING_LOCATION_WARNING).alias("message"),
        F.lit(rules.MISSING_LOCATION_RETRY).alias("retry_hint"),
    )

