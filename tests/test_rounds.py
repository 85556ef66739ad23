"""Texts read in rounds, descriptions left out of words, and outputs that need no listing."""

import pytest
from pyspark.sql import functions as F

from roost import schema
from roost.operators import filters as flt
from roost.operators import prune, search
from roost.operators.score import prepare_listings, with_score
from roost.plans.search_plan import plan_requests, plan_tasks
from test_prune import listings, searches


@pytest.mark.parametrize(("seed", "scope", "broadcast"), [(11, "crawl", 64 << 20), (12, "city", 0)])
def test_rounds_pick_what_scoring_every_pair_picks(spark, monkeypatch, seed, scope, broadcast):
    monkeypatch.setattr(search, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(prune, "READ_AT_ONCE", 0)
    monkeypatch.setattr(prune, "READ_FIRST", 2)
    read, read_signals = [], prune.read_signals

    def noting(*args):
        read.append(read_signals(*args))
        return read[-1]

    monkeypatch.setattr(prune, "read_signals", noting)
    # some rows twice and some without an id
    table = listings(spark, 900, seed).withColumn("canonical_id", F.when(F.col("price_eur") != 77_000, F.col("canonical_id")))
    table = table.unionByName(table.filter("price_eur < 90000")).persist()
    tasks = plan_tasks(plan_requests(searches(spark)).withColumnRenamed("search_id", search.RUN), search.RUN).persist()
    profile = search.profile_tasks(tasks)
    picked, stats = search.pick_rows(table, tasks, profile, scope)
    columns = [*search.TASK, "canonical_id", "task_rank", "score", "score_open", "why_matched", "floor_pass"]
    got = sorted(map(str, picked.select(*columns).collect()))
    matched = search.match_listings(prepare_listings(table.filter("canonical_id is not null")), tasks, profile, scope).filter(flt.base_ok())
    scored = with_score(matched.withColumn("floor_pass", flt.floor_ok()), open_floor=True)
    want = sorted(map(str, search._pick_per_task(scored, tasks, stats, profile).select(*columns).collect()))
    assert len(want) > 60 and got == want
    assert len(read) == 2
    # one round read more texts than the two
    monkeypatch.setattr(prune, "READ_AT_ONCE", 1 << 40)
    search.pick_rows(table, tasks, profile, scope)
    assert read[0].count() + read[1].count() < read[2].count()


def test_descriptions_without_a_hint_hold_the_same_hints(spark):
    texts = ["un Céntro claro", "nada de nada aquí", "", None, "中文", "Casa san", "juan y más", "alto"]
    rows = [
        dict.fromkeys((f.name for f in schema.LISTING.fields)) | dict(canonical_id=f"{i}-{j}", description=t, city=c, title=h, source_path=p, chars=x)
        for i, t in enumerate(texts)
        for j, (c, h, p, x) in enumerate([("Centro", "x", "/san", None), ("San", "a san", "juan/alto", None), (None, "casa san", None, ["juan", None]), ("x|y", None, "", [])])
    ]
    table = spark.createDataFrame(rows, schema.LISTING)
    hints = F.array(*[F.lit(h) for h in ("Centro", "San Juan", "san  juan y", "Álto", "nada", "-")])
    held = [
        {r.canonical_id: r.h for r in prepare_listings(table, False, True, w).select("canonical_id", prune._hints_held(hints).alias("h")).collect()}
        for w in (None, ["alto", "centro", "juan", "nada", "san", "y"])
    ]
    assert held[0] == held[1] and sum(map(bool, held[0].values())) > 20
    unread = prepare_listings(table, False, True, ["ronda"]).filter("canonical_id = '1-0'").first()
    assert "nada" not in unread.search_text


def test_failures_and_action_required_read_no_listing(spark, monkeypatch):
    def none(*args):
        raise AssertionError("listings were read")

    monkeypatch.setattr(search, "staged_picks", none)
    names = [f.name for f in schema.SEARCH.fields]
    asked = [dict(search_id="fail", city="Valencia", sources=["habitaclia", "pisos"]), dict(search_id="some", city="Madrid", sources=["habitaclia", "pisos"]), dict(search_id="where")]
    rows = spark.createDataFrame([{**dict.fromkeys(names), **a} for a in asked], schema.SEARCH)
    outcomes = spark.createDataFrame(
        [("pisos", "valencia", "scrape", [], "UPSTREAM_BLOCKED", "no"), ("habitaclia", "valencia", "scrape", [], "AUTH_REJECTED", "no"),
         ("pisos", "madrid", "scrape", [], "UPSTREAM_BLOCKED", "no")],
        schema.OUTCOME,
    )
    out = search.run_search(rows, listings(spark, 20, 1), outcomes)
    assert [(r.search_id, r.error_code) for r in out.failures.collect()] == [("fail", "AUTH_REJECTED")]
    assert [r.search_id for r in out.action_required.collect()] == ["where"]
    with pytest.raises(AssertionError):
        out.coverage
