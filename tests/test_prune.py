"""The pruned top-k against scoring every pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roost import schema
from roost.operators import filters as flt
from roost.operators import prune, search
from roost.operators.score import prepare_listings, with_score
from roost.plans.search_plan import plan_requests, plan_tasks

TEXTS = [None, "", "Piso exterior con luz natural", "orientación sur, ventanales", "para reformar en el Centro", "Zona Alto"]


def listings(spark, n, seed):
    draw = random.Random(seed)
    names = [f.name for f in schema.LISTING.fields]
    rows = []
    for i in range(n):
        place = draw.choice(["Valencia", "Madrid", "Gijón"])
        row = dict.fromkeys(names)
        row.update(
            canonical_id=f"c{i}", portal=draw.choice(["pisos", "fotocasa"]), portal_listing_id=f"c{i}", url=f"https://x.example/{i}",
            title=f"Title {i}", city=draw.choice([place, "", "Centro", None]), price_eur=draw.choice([None, 0.0, *range(50_000, 400_000, 1000)]),
            rooms=draw.choice([None, 0.0, 1.0, 2.0, 3.5, 5.0]), property_type=draw.choice([None, "flat", "house", "office"]),
            image_urls=["u"] * draw.randint(0, 9), last_seen_at=dt.datetime(2026, 1, draw.randint(1, 28)), description=draw.choice(TEXTS),
            tags=draw.choice([None, [], ["Views"], ["natural_light", "exterior"]]), capacity_people=draw.choice([None, 4.0, 20.0]),
            source_path=draw.choice([None, f"/venta/pisos-{place.lower()}_capital/"]), crawl_location=place, seq=draw.choice([None, i]),
            chars=[] if place == "Gijón" else draw.choice([None, ["Bajo"], ["3ª planta"], ["6ª planta", "2 habs."]]),
        )
        row["price_eur"] = None if row["price_eur"] is None else float(row["price_eur"])
        rows.append(row)
    return spark.createDataFrame(rows, schema.LISTING)


def searches(spark):
    names = [f.name for f in schema.SEARCH.fields]
    asked = [
        dict(city="Valencia", max_price_eur=250000, min_rooms=2, per_location_limit=3, tags=["natural_light"], location_hints=["Centro", "Alto"]),
        dict(city="Gijón", min_floor=2, per_location_limit=4, sources=["pisos", "fotocasa"]),
        dict(city="Gijón", min_floor=2, strict_constraints=False, per_location_limit=4, renovation_ok=True),
        dict(city="Madrid", min_floor=9, per_location_limit=2, prefer_exterior=True),
        dict(locations=["Madrid", "Valencia - Centro"], exclude_ground_floor=True, per_location_limit=5, property_types=["flat"]),
        dict(strict_constraints=False, max_results_total=6, tags=["Views"], renovation_ok=True, min_capacity_people=5),
        dict(city="Valencia", nearby_towns=True, strict_constraints=False, per_location_limit=50),
    ]
    rows = [{**dict.fromkeys(names), "search_id": str(i), **a} for i, a in enumerate(asked)]
    return spark.createDataFrame(rows, schema.SEARCH)


@pytest.mark.parametrize(("seed", "scope", "broadcast"), [(1, "crawl", 64 << 20), (2, "city", 64 << 20), (3, "crawl", 0)])
def test_picks_what_scoring_every_pair_picks(spark, monkeypatch, seed, scope, broadcast):
    monkeypatch.setattr(search, "BROADCAST_BYTES", broadcast)
    table = listings(spark, 900, seed).persist()
    tasks = plan_tasks(plan_requests(searches(spark)).withColumnRenamed("search_id", search.RUN), search.RUN).persist()
    profile = search.profile_tasks(tasks)
    assert profile.small == (broadcast > 0)
    picked, stats = search.pick_rows(table, tasks, profile, scope)
    columns = [*search.TASK, "canonical_id", "task_rank", "score", "score_open", "why_matched", "floor_pass", "description", "seq"]
    got = sorted(map(str, picked.withColumn("seq", F.nullif("seq", F.lit(-1))).select(*columns).collect()))
    matched = search.match_listings(prepare_listings(table), tasks, profile, scope).filter(flt.base_ok())
    scored = with_score(matched.withColumn("floor_pass", flt.floor_ok()), open_floor=True)
    want = sorted(map(str, search._pick_per_task(scored, tasks, stats, profile).select(*columns).collect()))
    assert len(want) > 60 and got == want


def test_bounds_enclose_the_score_of_every_pair(spark):
    table = listings(spark, 300, 5)
    tasks = plan_tasks(plan_requests(searches(spark)).withColumnRenamed("search_id", search.RUN), search.RUN)
    matched = search.match_listings(prepare_listings(table), tasks, search.profile_tasks(tasks), "crawl").filter(flt.base_ok())
    city = flt.has_city() & flt.city_match()
    rows = with_score(matched.withColumn("n_images", F.size("image_urls")))
    assert rows.filter((prune._least(city) > F.col("score")) | (prune._most(city) < F.col("score"))).isEmpty()
    assert not rows.filter(prune._least(city) < F.col("score")).isEmpty()


def test_number_rows_carry_no_question(spark, monkeypatch):
    """Rows per listing and task hold the number of the task: neither the question nor the digest of its run."""
    written = {}

    def noted(df, name):
        written[name] = df.columns
        return stage(df, name)

    stage = prune.stage
    monkeypatch.setattr(prune, "stage", noted)
    tasks = plan_tasks(plan_requests(searches(spark)).withColumnRenamed("search_id", search.RUN), search.RUN).persist()
    search.pick_rows(listings(spark, 200, 3), tasks, search.profile_tasks(tasks), "crawl")
    for name in ("blocks", "first-rows", "later-rows", "survivors"):
        assert "task_no" in written[name] and not {"q", "run_id"} & set(written[name])
