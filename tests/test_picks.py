"""What a search batch writes on its way: no texts but those of picked rows, no crowd of equal scores."""

import datetime as dt

from roost import schema
from roost.operators import prune, search
from roost.plans.search_plan import plan_requests, plan_tasks


def test_texts_are_written_for_picked_rows_only(spark, monkeypatch):
    names = [f.name for f in schema.LISTING.fields]
    fixed = dict(portal="pisos", crawl_location="Madrid", city="Madrid", price_eur=100_000.0, rooms=2.0, description="reformar en Centro", chars=[])
    day = dt.datetime(2026, 1, 1)
    crowd = [
        {**dict.fromkeys(names), **fixed, "canonical_id": f"c{i:03d}", "portal_listing_id": f"p{i}", "url": f"https://x.example/{i}", "title": f"T {i}", "seq": i, "last_seen_at": day + dt.timedelta(hours=i)}
        for i in range(300)
    ]
    table = spark.createDataFrame(crowd, schema.LISTING)
    asked = {**dict.fromkeys([f.name for f in schema.SEARCH.fields]), "search_id": "1", "city": "Madrid", "per_location_limit": 4, "sources": ["pisos"]}
    tasks = plan_tasks(plan_requests(spark.createDataFrame([asked], schema.SEARCH)).withColumnRenamed("search_id", search.RUN), search.RUN)
    written, stage = {}, prune.stage

    def noting(df, name):
        written[name] = stage(df, name)
        return written[name]

    monkeypatch.setattr(prune, "stage", noting)
    monkeypatch.setattr(search, "stage", noting)
    picked, _ = search.pick_rows(table, tasks, search.profile_tasks(tasks), "crawl")
    assert sorted(r.canonical_id for r in picked.collect()) == ["c296", "c297", "c298", "c299"]
    assert {name for name, df in written.items() if "description" in df.columns} == {"texts"}
    assert written["texts"].count() == 4 and written["survivors"].count() == 4
