"""Ranking, batch search, collapse, planning: small in-code rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roost import schema
from roost.operators.dedupe import collapse_duplicates
from roost.operators.rank import rank_listings
from roost.operators.search import run_search
from roost.plans.search_plan import plan_requests, split_requests
from roost.sources.readers import seed_listings

SEEN = dt.datetime(2026, 2, 25)


def listing(key, **fields):
    row = dict.fromkeys(f.name for f in schema.LISTING.fields)
    row.update(
        canonical_id=key, portal="pisos", portal_listing_id=key, url=f"https://x.example/{key}", title=f"Example {key}",
        city="Valencia", price_eur=300000.0, rooms=3.0, property_type="flat", image_urls=[], last_seen_at=SEEN,
        crawl_location="Valencia", seq=0,
    )
    row.update(fields)
    return row


def table(spark, rows):
    return spark.createDataFrame(rows, schema.LISTING)


def requests(spark, *rows):
    names = [f.name for f in schema.SEARCH.fields]
    return spark.createDataFrame([{**dict.fromkeys(names), **r} for r in rows], schema.SEARCH)


def ids(df):
    return [r.canonical_id for r in df.select("canonical_id").collect()]


def test_golden_scores(spark):
    seed = seed_listings(spark)
    one = rank_listings(seed, dict(property_types=["flat"], city="Valencia", nearby_towns=True, min_rooms=3,
                                   max_price_eur=350000, tags=["renovation"], renovation_ok=True)).collect()
    assert [(r.canonical_id, r.score) for r in one] == [("pisos-fixture-1", 77)]
    two = rank_listings(seed, dict(property_types=["office"], city="Valencia")).collect()
    assert [(r.canonical_id, r.score) for r in two] == [("pisos-fixture-3", 65)]


BASE = dict(property_types=["flat"], city="Valencia", min_rooms=3, max_price_eur=350000)


def test_hard_constraints_and_city(spark):
    rows = table(spark, [listing("good"), listing("dear", price_eur=500000.0), listing("far", city="Madrid")])
    assert ids(rank_listings(rows, BASE)) == ["good"]
    path = "/venta/pisos-valencia_capital_zona_urbana/"
    rows = table(spark, [listing("in", city="Ciutat Vella (València Capital)"), listing("out", city="Massamagrell", source_path=path),
                         listing("path", city="", source_path=path)])
    assert sorted(ids(rank_listings(rows, BASE))) == ["in", "path"]


def test_floor_rules_and_light(spark):
    rows = table(spark, [listing("g", chars=["Bajo"]), listing("one", chars=["1ª planta"]), listing("four", chars=["4ª planta"]), listing("none")])
    assert ids(rank_listings(rows, {**BASE, "min_floor": 3, "exclude_ground_floor": True})) == ["four"]
    assert sorted(ids(rank_listings(rows, {**BASE, "min_floor": 3, "strict_constraints": False}))) == ["four", "none"]
    rows = table(spark, [listing("dark", chars=["1ª planta"], description="interior"),
                         listing("bright", chars=["7ª planta"], description="Muy LUMINOSO, orientación sur")])
    first = rank_listings(rows, {**BASE, "tags": ["natural_light"]}).first()
    assert first.canonical_id == "bright" and "Natural light / bright description" in first.why_matched
    assert "High floor (7ª) supports natural light" in first.why_matched


def test_null_rules(spark):
    rows = table(spark, [listing("p", price_eur=None), listing("r", rooms=None), listing("t", property_type=None), listing("c")])
    assert ids(rank_listings(rows, BASE)) == ["c"]
    assert len(ids(rank_listings(rows, {**BASE, "strict_constraints": False}))) == 4
    assert ids(rank_listings(rows, {"min_capacity_people": 1, "strict_constraints": False})) == []


def test_relax_failure_and_coverage(spark):
    rows = table(spark, [listing("a"), listing("h", portal="habitaclia", canonical_id="h"),
                         listing("n", portal="nuroa", canonical_id="n", chars=["Bajo"], title="Otro", city="Ronda", crawl_location="Ronda")])
    outcomes = spark.createDataFrame(
        [("habitaclia", "valencia", "scrape", [], "UPSTREAM_BLOCKED", "no"), ("pisos", "madrid", "scrape", ["w"], None, None)],
        schema.OUTCOME,
    )
    out = run_search(
        requests(spark, dict(search_id="relax", city="Valencia", min_floor=1, sources=["pisos", "habitaclia"]),
                 dict(search_id="keep", city="Ronda", min_floor=1, sources=["nuroa"]),
                 dict(search_id="fail", city="Valencia", sources=["habitaclia"]),
                 dict(search_id="blank", city="Madrid", sources=["pisos"])),
        rows, outcomes,
    )
    assert [(r.search_id, r.canonical_id) for r in out.results.collect()] == [("relax", "a")]
    diag = {r.search_id: r for r in out.diagnostics.collect()}
    assert set(diag) == {"relax", "keep", "blank"}
    assert any("Auto-relaxed floor filters for pisos in Valencia because 1 candidates" in w for w in diag["relax"].connector_warnings)
    assert diag["relax"].criteria.min_floor is None and diag["keep"].criteria.min_floor == 1
    assert diag["blank"].connector_warnings == ["w"] and diag["blank"].returned_count == 0
    assert [(r.search_id, r.error_code) for r in out.failures.collect()] == [("fail", "UPSTREAM_BLOCKED")]


def test_places_hints_and_fanout(spark):
    plan = {r.search_id: r for r in plan_requests(
        requests(spark, dict(search_id="a", city="València", locations=["València - Malilla", "València – Benicalap", "València"]),
                 dict(search_id="b", locations=["Ronda", "Madrid", "Bilbao"]), dict(search_id="c"), dict(search_id="d", sources=[])), 28).collect()}
    assert [p.location for p in plan["a"].places] == ["València"] and plan["a"].places[0].hints == ["Malilla", "Benicalap"]
    assert len(plan["b"].portals) == 9 and "Auto-capped to 9 sources" in plan["b"].request_warnings[0]
    assert plan["c"].status == "missing_locations" and plan["d"].status == "no_sources"
    rows = table(spark, [listing("x", city="Benicalap, Valencia", title="Uno dos tres"), listing("y", city="Malilla, Valencia", title="Otra cosa distinta")])
    out = run_search(requests(spark, dict(search_id="s", locations=["València - Malilla"], city="València")), rows)
    assert ids(out.results.orderBy("result_rank")) == ["y", "x"]


def test_bounds_reject_requests(spark):
    good, bad = split_requests(requests(spark, dict(search_id="ok", city="Ronda"), dict(search_id="x", max_results_total=500, tags=[""]), dict(search_id="y", sources=["zz"])))
    assert [r.search_id for r in good.collect()] == ["ok"]
    assert {r.search_id: r.errors for r in bad.collect()} == {"x": ["tags", "max_results_total"], "y": ["sources"]}


def test_equal_questions_run_once_and_scopes_agree(spark):
    rows = table(spark, [listing(f"k{i}", price_eur=100000.0 + 20000 * i, title=f"Casa {i} tipo{i}") for i in range(8)])
    ask = dict(city="Valencia", max_price_eur=220000)
    both = run_search(requests(spark, dict(search_id="a", **ask), dict(search_id="b", **ask), dict(search_id="c", city="Valencia")), rows)
    got = {}
    for r in both.results.orderBy("result_rank").collect():
        got.setdefault(r.search_id, []).append(r.canonical_id)
    assert got["a"] == got["b"] and len(got["a"]) == 7 and len(got["c"]) == 8
    city = run_search(requests(spark, dict(search_id="a", **ask)), rows, scope="city")
    assert ids(city.results.orderBy("result_rank")) == got["a"]


def brute_force(items):
    """Keep-first loop over ordered rows, in plain Python."""
    from roost.functions.text import TITLE_STOPWORDS

    def tokens(t):
        return {w for w in t.split() if len(w) >= 3 and w not in TITLE_STOPWORDS}

    def near(a, b):
        if a["city"] and b["city"] and a["city"] not in b["city"] and b["city"] not in a["city"]:
            return False
        if a["price"] is not None and b["price"] is not None:
            if abs(a["price"] - b["price"]) > max(5000, int(min(a["price"], b["price"]) * 0.05 + 0.5)):
                return False
        if a["rooms"] is not None and b["rooms"] is not None and abs(a["rooms"] - b["rooms"]) > 1:
            return False
        if not a["title"] or not b["title"]:
            return False
        ta, tb = tokens(a["title"]), tokens(b["title"])
        return a["title"] == b["title"] or bool(ta and tb and len(ta & tb) / min(len(ta), len(tb)) >= 0.9)

    kept, urls = [], set()
    for x in items:
        if x["url"] in urls or any(near(x, k) for k in kept):
            continue
        kept.append(x)
        urls.add(x["url"])
    return [k["id"] for k in kept]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_collapse_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, expected = [], {}
    for search in ("s", "t"):
        items = []
        for i in range(60):
            words = rnd.sample(["alfa", "beta", "gamma", "delta", "piso", "en"], rnd.randint(0, 4))
            x = dict(id=f"{search}{i:03d}", url=f"u.example/{rnd.randint(0, 40)}", city=rnd.choice(["", "ronda", "ronda alta", "madrid"]),
                     price=rnd.choice([None, *(100000.0 + 3000 * k for k in range(20))]), rooms=rnd.choice([None, 1.0, 2.0, 3.0]), title=" ".join(words))
            items.append(x)
            rows.append((search, x["id"], "https://" + x["url"], x["city"], x["price"], x["rooms"], x["title"], 100 - i, SEEN, i))
        expected[search] = brute_force(items)
    df = spark.createDataFrame(rows, "search_id string, canonical_id string, url string, city string, price_eur double, rooms double, title string, score int, last_seen_at timestamp, arrival int")
    got = {r.search_id: (r.ids, r.removed) for r in collapse_duplicates(df).select(
        "search_id", F.transform("kept", lambda k: k["canonical_id"]).alias("ids"), "removed").collect()}
    assert {k: v[0] for k, v in got.items()} == expected
    assert all(v[1] == 60 - len(expected[k]) for k, v in got.items())


def test_search_plan_has_no_python_and_no_cross_join(spark):
    rows = table(spark, [listing("a")])
    plan = rank_listings(rows, BASE, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "TakeOrderedAndProject" in plan
    from roost.operators.search import match_listings, profile_tasks
    from roost.operators.score import prepare_listings, with_score
    from roost.operators.rank import listing_order, top_per_group
    from roost.plans.search_plan import plan_tasks

    tasks = plan_tasks(plan_requests(requests(spark, dict(search_id="s", city="Valencia"))))
    matched = with_score(match_listings(prepare_listings(rows), tasks, profile_tasks(tasks), "crawl"))
    top = top_per_group(matched, ["search_id", "loc_pos", "src_pos"], listing_order(), F.col("cap"), 200, "r")
    text = top._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "WindowGroupLimit" in text


def test_asked_limits_above_200_lose_no_row(spark):
    rows = table(spark, [listing(f"k{i:03d}", title=f"Word{i} other{i} third{i}", price_eur=100000.0 + 500 * i) for i in range(400)])
    out = run_search(requests(spark, dict(search_id="a", operation="buy", property_types=["flat"], city="Valencia", sources=["pisos"],
                                          strict_constraints=True, per_location_limit=300, max_results_total=300)), rows)
    assert out.results.count() == 300


def test_seventh_place_keeps_its_slot(spark):
    places = ["Aaa", "Bbb", "Ccc", "Ddd", "Eee", "Fff", "Ggg"]
    rows = table(spark, [
        listing(f"{p}{n}", title=f"{p}word{n} {p}x{n} {p}y{n}", city=p, crawl_location=p, price_eur=100000.0 + 1000 * k + 50000 * (n == 0) * (k == 6))
        for k, p in enumerate(places) for n in range(3)
    ])
    out = run_search(requests(spark, dict(search_id="a", operation="buy", property_types=["flat"], locations=places, sources=["pisos"],
                                          strict_constraints=True, per_location_limit=10, max_results_total=21)), rows)
    first = [r.canonical_id[:3] for r in out.results.orderBy("result_rank").collect()][:7]
    assert sorted(first) == places
